"""Sentences for the recogniser of names that neither its training nor the data's texts hold; {N} is a name, {X} none."""

PERSONS = {
    "en": ("Ann Velucci|Gordon Brightwater|Hester O'Malley|Rowan Quist|Tessa Marlowe-Finch", "Questions go to {N}, second floor.|Interview with {N}.|According to {N}, the bridge is safe.|The prize was won by {N} last year.|Mrs. {N} teaches the piano.|{N} told the court about it.|Photo: {N}|Please forward this to {N} at once.|Her uncle, {N}, grew roses.|Best wishes, {N}|The chair thanked {N}.|Dr. {N} saw the patient."),
    "de": ("Wiebke Sandmann|Lothar Quess|Anneliese Braun-Vogt|Dietmar Kessler", "Auskunft erteilt Frau {N}.|Laut {N} ist die Brücke sicher.|Der Preis ging an {N}.|{N} fragte nach dem Weg.|Foto: {N}|Herr {N} leitet die Schule.|Viele Grüße, {N}|Ihr Onkel {N} züchtete Rosen."),
    "fr": ("Odile Garnaud|Armand Lestrange|Maëlle Quintin|Thibaut Roche-Noire", "Selon {N}, le pont est sûr.|Le prix est allé à {N}.|{N} demande le chemin.|Photo : {N}|Mme {N} enseigne le piano.|Bien à vous, {N}|Son oncle, {N}, cultivait des roses."),
    "es": ("Nuria Valcárcel|Gonzalo Rivas|Remedios Lauveaux|Hilario Tormo", "Según {N}, el puente es seguro.|El premio fue para {N}.|{N} preguntó por el camino.|Foto: {N}|La señora {N} enseña piano.|Un saludo, {N}|Su tío, {N}, cultivaba rosas."),
    "pt": ("Leonor Bragança|Duarte Pimentel|Iria Fontes|Anacleto Rocha", "Segundo {N}, a ponte é segura.|O prémio foi para {N}.|{N} perguntou pelo caminho.|Foto: {N}|A senhora {N} ensina piano.|Um abraço, {N}|O tio dela, {N}, cultivava rosas."),
    "ru": ("Тихон Белогорский|Марфа Зеленцова|Игнат Ярославцев|Злата Рощина", "По словам соседей, {N} уехал.|Премию получила {N} в прошлом году.|{N} спросил дорогу.|Фото: {N}|Музыке учит {N}.|С уважением, {N}|Её дядя, {N}, разводил розы."),
    "ar": ("بوشتى الكرديسي|نزهة الرمديسي|الطاهر البوعزاوي|غيثة السلراني", "حسب {N} فإن الجسر آمن.|فاز {N} بالجائزة.|سأل {N} عن الطريق.|الصورة: {N}|السيدة {N} تدرس الموسيقى.|مع تحيات {N}."),
}
#: Given names that no table has, behind a title, a label or before a verb of persons.
UNKNOWN = "Priyanka Rao|Oluwaseun Adeyemi|Kjersti Haugland|Zbigniew Kowal"
WITH_TITLE = "Mr. {N} arrived late.|Please ask Mrs. {N} for the form.|Dr. {N} will see you.|Author: {N}|Written by {N}|{N} said nothing.|{N} lives upstairs.|Frau {N} unterschrieb den Vertrag.|Mme {N} habite au premier.|La señora {N} firmó la carta."
THINGS = (
    "The bus to Gordon Square leaves at ten.|Martin Street is closed.|Charlotte House was sold to Victoria Holdings Ltd.|We met at Saint Martin School.|The Old Mill opened in May.|In North Harwick the snow lay deep.|Great Western Works hired forty people.|Sections A. Scope and B. Terms follow.|Monday Morning News|Thomas Bridge is safe.|"
    "Der Zug nach Bad Kelheim hielt.|Die Gustav Weber GmbH zog um.|Der Hamburger Hafen wächst.|Das Werkzeug, z. B. Seile, fehlt.|Le train de Saint Malo part.|La place Victor Hugo est fermée.|La Banque Centrale publie un rapport.|La plaza Santa Clara está llena.|El Banco Nacional abrió.|"
    "A praça Santa Maria fica longe.|Улица Льва Толстого закрыта.|Нижний Новгород встречает гостей.|شارع محمد الخامس مغلق.|سقط الثلج على الجبل الكبير."
).split("|")
