"""Names of persons in running text: candidates by shape, judged by a trained classifier.

A candidate is a run of two or three words that is written like a name: given
and family name, with initials, with particles, or the family name first with a
comma; in Arabic, which has no capitals, two words of which the first is a
given name or follows a title. A logistic model judges it by features of its
words (a table of given names, initials, function words, words for streets and
firms), of its neighbours and of a title or label before it. The model is
trained once in each Python worker (a fraction of a second) on sentences made
from the frames below with names, places and firms put in at random; part of
the given names is made up, so that the neighbours get weights of their own.

Defined results: an empty text has no names; of overlapping candidates the most
probable stays, of equal ones the longer, and one with two given names before
its part.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

UP = "A-ZÀ-ÖØ-ÞŒŠŽ"
_PART = rf"(?:[{UP}]['’])?[{UP}][\w'’]*\w"
WORD = rf"{_PART}(?:-{_PART})*"
CYR = r"[А-ЯЁ][а-яёА-ЯЁ]+(?:-[А-ЯЁ][а-яёА-ЯЁ]+)*"
ARA = r"[ء-غف-يٱکیہًٌٍَُِّْ]{2,}"

#: Titles that don't belong to the name.
TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|M|Mme|Mlle|Sr|Sra|Srta|D|Dña|Hr|Fr|Me|Rev|Capt)\.?\s|(?:Frau|Herrn?|Madame|Monsieur|Señora?|doña|don|dona|Dona|Dom|Senhora?|Mme|Mlle|Miss|the late|Doctor|Professor|Sir|Lady|Doktor|Docteur|Doctora?|Doutora?|Professeur|господин|госпожа|г-н|г-жа|доктор|профессор|السيدة?|الدكتورة?|الأستاذة?|الآنسة)\s)"
_TITLE = re.compile(TITLE)
_TITLES = re.compile(rf"(?<![^\W_])(?:{TITLE})+\Z")

#: Given names by gender, of one script each.
GIVEN = (
    (
        "Ada Agnes Agathe Alice Alicia Amanda Amélie Ana Andrea Angela Anita Anja Ann Anna Anne Anneliese Antonia Apolline Astrid Barbara Bea Beatrice Beatriz Benedita Berta Birgit Brigitte Camila Camille Carla Carmen Carolina "
        "Caroline Catarina Catherine Cécile Céline Charlotte Chloé Christine Clara Claire Claudia Cora Cristina Dagmar Daniela Diana Dolores Dora Dorothea Edda Edith Elena Eleanor Elisabeth Elizabeth Élodie Emilia Emily Emma Erika Esther Eva Evelyn "
        "Fátima Fay Fernanda Florence Frauke Frieda Gabriela Geneviève Gisela Gloria Grace Graça Greta Gudrun Hanna Hannah Heike Helen Helena Helga Hélène Hester Hilda Hildegard Ida Imogen Inès Inês Ingrid Irene Iria Iris Irma Isabel "
        "Isabella Itziar Jana Jane Janet Jeanne Jennifer Jessica Joana Johanna Josefa Judith Julia Juliette June Karen Karin Katharina Kay Laura Lena Leonor Lina Linda Lisa Louise Lourdes Lucía Lucie Luisa Lydia Maëlle Mara Margaret Margarida Margot "
        "María Maria Mariana Marie Marina Marion Marta Martha Martina Mary Mathilde Matilde Mercedes Mia Michelle Miriam Mona Monica Monika Nadia Nancy Natalia Nathalie Nell Nina Nora Nuria Odile Olga Olivia Patricia Paula Pauline Petra Pilar Rachel "
        "Rebecca Regina Remedios Renate Rita Rosa Rosalie Rosario Ruth Sabine Sandra Sara Sarah Silke Silvia Simone Sofía Sofia Solène Sonia Sophie Stefanie Susan Susana Susanne Sylvie Teresa Tessa Thea Theresa Uma Ulrike Ursula Valentina Valérie Vera "
        "Verónica Victoria Virginie Wanda Wiebke Yara Yolanda Yvonne Zoe"
    ).split(),
    (
        "Abel Adam Adrian Albert Alberto Alexander Alexandre Alfred Alfonso Álvaro Anacleto Andreas Andrew André Andrés Anselmo Anthony Antoine António Antonio Armand Arnaud Arthur Artur Axel Barnaby Bastien Benjamin Benoît Bernard Bernd Bernhard Boris "
        "Brian Bruno Carl Carlos Charles Christian Christoph Claude Clive Cristóbal Damien Daniel David Dean Denis Detlef Diego Dieter Dietmar Dominik Donald Duarte Eckhard Edmund Eduardo Edward Edwin Egon Emil Emilio Enrique Eric Ernst Esteban Étienne "
        "Eugen Eusebio Fabian Felipe Felix Fermín Fernando Filipe Florian Francis Francisco Franck François Frank Frédéric Friedrich Gabriel Gaspar Gaspard Geoffrey George Georg Gerald Gérard Gerhard Gilles Gonçalo Gonzalo Gordon Graham Gregor Guillaume "
        "Guillermo Gustav Gustavo Hans Harald Harold Hartmut Heinrich Heinz Henri Henrique Henry Herbert Hermann Hilario Horst Hubert Hugo Ian Ignacio Ivan Jacob Jacques Jakob James Javier Jean Jens Joachim João Joaquim Joaquín Johann Johannes John Jonas "
        "Jonathan Jordi Jorge Jörg José Joseph Juan Jules Julien Jürgen Karl Keith Kenneth Kevin Klaus Konrad Kurt Lars Laurent Leon Leonard Lothar Louis Luc Lucas Ludwig Luis Luís Manfred Manuel Marc Marcel Marco Marcos Mario Mark Markus Martin Mateus "
        "Mathieu Matthew Matthias Maurice Max Michael Michel Miguel Moritz Nicolas Nigel Nils Norbert Nuno Oliver Olivier Oskar Óscar Otto Pablo Pascal Patrick Paul Paulo Pedro Peter Philip Philippe Pierre Rafael Rainer Ralf Ramón Raúl Raymond Régis Rémi "
        "René Ricardo Richard Robert Roberto Rodrigo Roger Roland Rolf Rowan Rui Samuel Santiago Sebastian Sergio Siegfried Simão Simon Stefan Stephen Steven Sven Theo Thibaut Thierry Thomas Tiago Timothy Tobias Tomás Tomé Udo Ulrich Uwe Vasco Vicente "
        "Victor Viktor Vincent Volker Walter Werner Wilhelm William Wolfgang Xavier Yves Zeno"
    ).split(),
    (
        "Агата Агафья Аглая Александра Алина Алиса Алла Анастасия Анна Антонина Анфиса Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарья Диана Евгения Евдокия Екатерина Елена Елизавета Жанна Зинаида Злата Зоя "
        "Инна Ирина Кира Клавдия Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Марфа Матрёна Милана Надежда Наталья Наталия Нина Оксана Олеся Ольга Пелагея Полина Прасковья Раиса Регина Римма Светлана Серафима София Софья "
        "Таисия Тамара Татьяна Ульяна Фаина Фёкла Юлия Яна"
    ).split(),
    (
        "Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор "
        "Ефим Захар Иван Игнат Игорь Илья Иосиф Кирилл Константин Лев Леонид Лука Макар Максим Марк Матвей Михаил Никита Николай Олег Остап Павел Пётр Прохор Роман Руслан Савелий Святослав Семён Сергей Станислав Степан Тарас Тимофей "
        "Тимур Тихон Фёдор Филипп Эдуард Юрий Яков Ярослав"
    ).split(),
    "رحمة نزهة غيثة زهور فاطمة عائشة خديجة مريم زينب ليلى سعاد سميرة نادية حليمة سلمى أمينة كريمة لطيفة مليكة نجاة هند ياسمين سناء حنان بشرى فوزية رقية صفية جميلة نعيمة سمية هدى إيمان أسماء رجاء وفاء منى سارة نورة لمياء".split(),
    "بوشتى الطاهر العربي المكي محمد أحمد علي حسن حسين عمر عثمان يوسف إبراهيم إسماعيل خالد سعيد كريم رشيد حميد مصطفى إدريس عزيز جمال كمال طارق ياسين هشام نبيل فؤاد سليمان موسى عيسى أيوب حمزة بلال أنس رضا مراد المهدي الحسين".split(),
)
GENDER = {name: k for k, pool in enumerate(GIVEN) for name in pool}

#: Small words inside names.
_PARTICLE = r"(?:de\sla|de\slos|van\sder|van\sden|von\sder|de|del|da|do|dos|das|di|du|von|van|zu|bin|ben|al|el|ter)"
#: Words before a person.
BEFORE = set(
    "by with met contact dear ask thank thanks tenant owner author editor signed from told called named cc attn attention "
    "von an bei mit nach frage fragen fragt kontakt liebe lieber mieter mieterin autor autorin gezeichnet unterschrieben traf dank danke ruft heißt durch "
    "par avec chez cher chère demandez contactez contacter auteur signé locataire rencontré croisé merci écrire écrivez appelle nommé "
    "por con contacte contactar autor firmado querido querida inquilino inquilina gracias pregunte encontré llamado llama escriba vi "
    "com contacte caro cara assinado inquilino inquilina obrigado pergunte encontrei chamado escreva "
    "спросите где отвечает подписывает спасибо встретил встретила благодарим автор уважаемый уважаемая от подписал подписала стойке "
    "العقد الكامل الاسم شكرا مع قابلت المستأجر المؤلف عزيزي السيد".split()
)
#: Words after a person.
AFTER = set(
    "said says wrote writes asked asks lives lived works worked called calls signed signs arrived arrives left presented told tells thinks explained replied added agreed near who came spoke speaks "
    "sagte sagt schrieb schreibt wohnt wohnte lebt arbeitet arbeitete unterschrieb kam legte erklärte rief fragte meinte antwortete "
    "dit écrit habite habitait travaille travaillait signa présenté explique expliqua demande répondit arrive "
    "dijo dice escribe escribió vive vivía trabaja trabajaba firmó llegó presentó explicó preguntó respondió "
    "disse diz mora morava vive trabalha trabalhava assinou chegou apresentou escreveu explicou perguntou "
    "сказал сказала пишет живёт работает подписал подписала пришёл пришла показывает отвечает ответил ответила "
    "قال قالت يسكن تسكن يعمل تعمل كتب كتبت وقع وقعت وصل وصلت حضر حضرت والهاتف هو هي".split()
)
#: Words before a place.
AT = set("in at near to into across through over around im am nach aus bei zum zur à au aux en dans vers près a al hacia cerca no na em para perto ao в из на у возле около في من إلى قرب شارع ساحة مدينة".split())
#: Words that make a name one of a street, a place or a firm.
THINGS = set(
    "street st road rd lane avenue ave square terrace close drive way court row hill gardens crescent park station bridge river lake island valley market house hall school university college church museum hotel bank hospital library office union council committee department ministry institute society club press news times theatre airport port bay "
    "ltd limited inc corp company co llc plc gmbh ag kg ohg sarl sa sl lda ltda group holdings partners brothers sons bros cie foundation trust works systems services introduction results appendix method summary scope terms "
    "straße strasse weg gasse allee platz ufer damm ring brücke bahnhof schule amt verein verlag werk rue boulevard bd quai place chemin allée impasse gare pont école mairie société calle plaza paseo avenida camino estación puente escuela ayuntamiento rua travessa largo praça alameda estação ponte escola câmara "
    "улица ул переулок проспект площадь набережная станция мост школа ооо зао оао شركة مدرسة جامعة محطة سوق ساحة شارع نهر".split()
)
#: Words that begin sentences, days and months.
COMMON = set(
    "the a an this that these those his her their our my your its we i he she they it you in on at by for from with when while after before if as but and or not no yes all some many most every each there here please dear yesterday today tomorrow call see ask write read "
    "home search login jobs help archive archives gallery news about services contact hours privacy menu accueil aide emplois horaires galerie actualités inicio buscar ayuda empleo galería noticias início procurar ajuda galeria suche hilfe anmelden karriere aktuelles kontakt dienste stellen über dieser diese dieses ihre ihren unser unsere unserer einstellungen recherche connexion paramètres empregos arquivo lamentamos entrar pesquisa empleos entrar ajustes settings your "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december page chapter section figure table part note "
    "der die das ein eine einen dem den des er sie es wir ich ihr im am zum zur bei mit nach von vor für auf aus über unter wenn als aber und oder nicht bitte siehe gestern heute seite kapitel montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember "
    "le la les un une des du de ce cette il elle nous vous ils elles je on dans sur avec pour par mais et ou si quand merci hier demain voir page chapitre lundi mardi mercredi jeudi vendredi samedi dimanche "
    "el los las una unos este esta él ella nosotros ellos yo en con por para pero y o si cuando gracias ayer mañana hoy véase página lunes martes miércoles jueves viernes sábado domingo "
    "o os as um uma este esta ele ela nós eles eu em com por para mas e ou se quando obrigado ontem amanhã hoje segunda terça quarta quinta sexta "
    "в на из от по для при с о и но а не это эта этот он она они мы вы я как если когда спасибо вчера завтра".split()
)
#: Labels before a person's name.
_LABEL = re.compile(r"(?:name|author|by|contact|from|to|attn|signed|cc|owner|tenant|editor|nom|auteur|signé|nombre|autor|autora|firmado|nome|assinado|kontakt|verfasser|имя|фио|автор|الاسم|المؤلف)\s?[:;=–-]\s?\Z", re.IGNORECASE)

_LATIN = re.compile(rf"(?<![\w@.'’-])(?:(?P<i>[{UP}]\.)(?=\s?(?:[{UP}]\.|{WORD}|{_PARTICLE}\s))|(?P<w>{WORD}))(?![\w@])")
_CYRILLIC = re.compile(rf"(?<![\w@.-])(?:(?P<i>[А-ЯЁ]\.)|(?P<w>{CYR}))(?![\w@])")
_ARABIC = re.compile(rf"(?<![^\W_]){ARA}(?![^\W_])")
_HAS_LATIN, _HAS_CYRILLIC, _HAS_ARABIC = re.compile(f"[{UP}]"), re.compile("[А-ЯЁ]"), re.compile("[ء-ي]")
_GAP = re.compile(rf"\s(?:{_PARTICLE}\s)?\Z")
_PREVIOUS = re.compile(r"([^\W\d_]+)([^\w]*)\Z")
_NEXT = re.compile(r"(\W*)(\w+)")
#: Endings of Russian given names in the other cases.
_CASES = (("й", "я ю ем е"), ("ь", "я ю ем е и ью"), ("а", "ы е у ой и"), ("я", "и е ю ей"), ("", "а у ом е"))


def _inflected(name: str) -> list[str]:
    end, forms = next((e, f) for e, f in _CASES if name.endswith(e))
    return [name[: len(name) - len(end)] + f for f in forms.split()]


_LEXICON = {**{f: "lex_case" for name in (*GIVEN[2], *GIVEN[3]) for f in _inflected(name)}, **dict.fromkeys(GENDER, "lex")}


def known(word: str) -> str | None:
    """Whether the table of given names has a word, in any letter case."""
    own = _LEXICON.get(word)
    if own or not word.isupper():
        first = word.split("-")[0]
        return own or (_LEXICON.get(first) if first != word else None)
    return _LEXICON.get(word.capitalize())


def _candidates(s: str):
    """``start, end, form, first, last, given`` of each run of words that is written like a name; ``given`` is where the given name stands."""
    for pattern, some in ((_LATIN, _HAS_LATIN), (_CYRILLIC, _HAS_CYRILLIC)):
        if not some.search(s):
            continue
        run: list[tuple[int, int, bool]] = []
        last_end = -1
        for x in pattern.finditer(s):
            start, end = x.span()
            if run and not (start == last_end + 1 and s[last_end].isspace() or _joined(s, last_end, start)):
                if len(run) > 1:
                    yield from _of_run(s, run)
                run = []
            run.append((start, end, x.lastgroup == "i"))
            last_end = end
        if len(run) > 1:
            yield from _of_run(s, run)
    if not _HAS_ARABIC.search(s):
        return
    words = [x.span() for x in _ARABIC.finditer(s)]
    for (a, b), (c, d) in zip(words, words[1:]):
        if c == b + 1 and s[b].isspace():
            yield a, d, "pair", s[a:b], s[c:d], s[a:b]


def _joined(s: str, end: int, start: int) -> bool:
    if start - end > 11:
        return False
    gap = s[end:start]
    return gap in ("", ", ") or bool(_GAP.match(gap))


def _of_run(s: str, run: list[tuple[int, int, bool]]):
    """Candidates within a run of tokens that stand close together."""
    n = len(run)
    for i, (a, b, initial) in enumerate(run):
        if initial:
            j = i
            while j < n and run[j][2]:
                j += 1
            abbreviation = re.search(r"(?<![^\W_])[^\W\d_]\.\s?\Z", s[max(0, a - 4) : a])  # as in "z. B."
            if not abbreviation and j < n and j - i <= 3 and not any("," in s[run[k][1] : run[k + 1][0]] for k in range(i, j)) and (i == 0 or not run[i - 1][2]):
                yield a, run[j][1], "initials", s[run[j][0] : run[j][1]], s[run[j][0] : run[j][1]], ""
            continue
        j = i + 1
        if j == n:
            continue
        if "," in s[b : run[j][0]]:
            if not run[j][2]:
                yield a, run[j][1], "comma", s[a:b], s[run[j][0] : run[j][1]], s[run[j][0] : run[j][1]]
            continue
        while j < n and run[j][2] and "," not in s[run[j][1] : run[j + 1][0] if j + 1 < n else run[j][1]]:
            j += 1
        if j == n or run[j][2] or j - i > 3 or "," in s[run[j - 1][1] : run[j][0]]:
            if run[i + 1][2] and "Ѐ" <= s[a] <= "ӿ":  # family name first, initials after
                k = i + 1
                while k + 1 < n and run[k + 1][2] and k - i < 2:
                    k += 1
                yield a, run[k][1], "initials", s[a:b], s[a:b], ""
            continue
        yield a, run[j][1], "pair", s[a:b], s[run[j][0] : run[j][1]], s[a:b]
        k = j + 1
        if k < n and not run[k][2] and s[run[j][1] : run[k][0]].strip() == "" and (known(s[a:b]) and known(s[run[j][0] : run[j][1]]) or s[a] > "Ѐ" and re.search("(?:вич|вна|вича|вны)$", s[run[j][0] : run[j][1]])):
            yield a, run[k][1], "three", s[a:b], s[run[k][0] : run[k][1]], s[a:b]


def _untitled(s: str, start: int, end: int) -> int:
    """Where a candidate begins without titles, as long as two words of it are left."""
    while (title := _TITLE.match(s, start, end)) and re.search(r"[\s,]", s[title.end() : end]):
        start = title.end()
    return start


def _around(s: str, start: int, end: int) -> tuple[int, str, str, str, str]:
    """Start of a title before a place, the word before that with what stands between, and the same behind."""
    before = s[max(0, start - 48) : start]
    title = _TITLES.search(before)
    cut = start - (len(before) - title.start()) if title else start
    p, n = _PREVIOUS.search(s, max(0, cut - 30), cut), _NEXT.match(s, end, end + 40)
    before, behind = p.group(2) if p else s[max(0, cut - 3) : cut], n.group(1) if n else ""
    # words of another sentence are no neighbours
    prev = p.group(1).lower() if p and not re.search(r"[.!?؟।。]", before) else ""
    nxt = n.group(2).lower() if n and not behind.strip(" ,\t\n") else ""
    return cut, prev, before, nxt, behind


#: The last word of a title, as it stands before a name.
_TITLE_WORDS = set("dr prof mr mrs ms m mme mlle sr sra srta d dña hr fr me rev capt frau herr herrn madame monsieur señor señora doña don dona dom senhor senhora miss late doctor professor sir lady doktor docteur doctora doutor doutora professeur господин госпожа г-н г-жа доктор профессор السيد السيدة الدكتور الدكتورة الأستاذ الأستاذة الآنسة".split())


def _worth(s: str, candidate: tuple) -> bool:
    """Whether anything may speak for a person, by a quick look at the words beside."""
    start, end, form, first, _, given = candidate
    if form == "initials" or given and known(given) or first.lower() in _TITLE_WORDS:
        return True
    before = s[max(0, start - 40) : start].rstrip()
    before = before[before.rfind(" ") + 1 :]
    if before[-1:] in (":", ";", "=", "-", "–", "—") or before.strip(".,").lower() in _TITLE_WORDS or before.strip(",:—–-").lower() in BEFORE:
        return True
    after = s[end : end + 40].lstrip(" ,")
    stop = after.find(" ")
    return after[: stop if stop > 0 else len(after)].strip(".;:!?»”\"'()").lower() in AFTER


def features(s: str, candidate: tuple) -> list[str] | None:
    """Names of a candidate's features; None if nothing speaks for a person."""
    start, end, form, first, last, given = candidate
    lexicon = known(given) if given else None
    if form == "initials" and "Ѐ" <= first <= "ӿ" and first.isupper():
        return None  # such are the looks of text read in a wrong charset
    if not lexicon and re.search(r"\s[^\W\dA-ZÀ-ÞА-Я_]+\s", s[start:end]):
        return None  # only after a given name is a small word part of a name
    own = _untitled(s, start, end)
    cut, prev, before, nxt, behind = _around(s, start, end)
    prev_cap = bool(prev) and s[cut - len(before) - len(prev)].isupper()
    titled = cut < start or own > start
    label = bool(_LABEL.search(s[max(0, cut - 20) : cut]))
    person = prev in BEFORE and not before.strip(" ,:\t\n\r—–-")
    follows = nxt in AFTER and behind.strip(" ,") == ""
    if not (lexicon or titled or label or first < "\u0600" and (form == "initials" or person or follows)):
        return None
    low = {first.lower(), last.lower()}
    out = ["bias", "form_" + form, "p=" + prev, "n=" + nxt]
    out += [lexicon or "unknown"] + (["lexicon_" + form] if lexicon else [])
    facts = {
        "title": titled, "label": label, "person": person, "follows": follows, "at": prev in AT and before.strip() == "", "thing": bool(low & THINGS), "thing_before": prev in THINGS, "thing_after": nxt in THINGS and behind.strip(" .") == "",
        "common": bool(low & COMMON), "start": not prev or bool(re.search(r"[.!?:»”\"]\s*$", before)), "both": form in ("pair", "initials") and known(last) is not None, "prev_cap": prev_cap, "arabic": first > "\u0600", "number_before": bool(re.search(r"\d\W*$", s[max(0, cut - 4) : cut])),
        "number_after": nxt[:1].isdigit() and behind.strip() == "", "digit": any(c.isdigit() for c in first + last), "upper": first.isupper() and last.isupper() and form == "pair", "short": min(len(first), len(last)) < 3, "goes_on": bool(behind == " " and s[end + 1 : end + 2].isupper()),
    }
    on = [k for k, v in facts.items() if v]
    return out + on + [f"{k}_{lexicon or form}" for k in on if k in ("title", "label", "person", "follows", "at", "thing", "thing_before", "thing_after", "start", "common", "arabic")]


#: Sentences with a person {N}; {T} is a title or nothing.
WITH_PERSON = """
Please contact {T}{N} about the invoice.|The letter was written by {T}{N} in the spring.|{T}{N} said the roof would be mended.|We spoke with {T}{N} on Monday.|My neighbour {N} has two dogs.|Name: {N}|Author: {N}|Dear {T}{N}, thank you for the parcel.|{N} works at the mill.|A photograph by {N}.|Yesterday {N} called twice.|{T}{N} arrived late.|The keys are with {T}{N}, who lives upstairs.|Minutes taken by {N}.|I asked {N} to wait.|Sincerely, {N}|Her cousin {N} lives in the north.|A parcel for {T}{N} came today.|Give the keys to {T}{N}.|The vote went to {N}, not to the board.|Is {N} there?|A seat was kept for {N}.|She asked for {N}.|We waited for {T}{N}, as agreed.|{N} (room 12) has the plans.|The baker, {N}, opens at six.
Bitte wenden Sie sich an {T}{N} im Büro.|{T}{N} sagte, das Dach werde repariert.|Der Brief stammt von {T}{N}.|Wir sprachen mit {T}{N} am Montag.|Mein Nachbar {N} hat zwei Hunde.|Name: {N}|Verfasser: {N}|Liebe {N}, danke für das Paket.|{N} arbeitet in der Mühle.|Gestern rief {N} zweimal an.|Mit freundlichen Grüßen {N}|Die Bäckerin, {T}{N}, öffnet um sechs.|Ein Paket für {T}{N} kam an.|Geben Sie {T}{N} die Schlüssel.|Alles Gute an {N}!|Die Post ist für {N}.|Sie rief nach {N}.|{N} (Zimmer 12) hat die Pläne.
Veuillez contacter {T}{N} au bureau.|{T}{N} a dit que le toit serait réparé.|La lettre est de {T}{N}.|Nous avons parlé avec {T}{N} lundi.|Ma voisine {N} a deux chiens.|Nom : {N}|Auteur : {N}|Chère {N}, merci pour le colis.|{N} travaille au moulin.|Hier, {N} est arrivé tard.|Le boulanger, {T}{N}, ouvre à six heures.|Un colis pour {T}{N} est là.|Donnez les clés à {T}{N}.|Avec l'aide de {N}.|{N} (bureau 12) a les plans.
Póngase en contacto con {T}{N} en la oficina.|{T}{N} dijo que el tejado sería reparado.|La carta es de {T}{N}.|Hablamos con {T}{N} el lunes.|Mi vecina {N} tiene dos perros.|Nombre: {N}|Autor: {N}|Querida {N}, gracias por el paquete.|{N} trabaja en el molino.|Ayer {N} llegó tarde.|El panadero, {T}{N}, abre a las seis.|Un paquete para {T}{N} llegó hoy.|Dé las llaves a {T}{N}.|Con la ayuda de {N}.|{N} (sala 12) tiene los planos.
Fale com {T}{N} no escritório.|{T}{N} disse que o telhado seria reparado.|A carta é de {T}{N}.|Falámos com {T}{N} na segunda.|A minha vizinha {N} tem dois cães.|Nome: {N}|Autora: {N}|Cara {N}, obrigado pela encomenda.|{N} trabalha no moinho.|Ontem {N} chegou tarde.|O padeiro, {T}{N}, abre às seis.|Uma encomenda para {T}{N} chegou.|Dê as chaves a {T}{N}.|Com a ajuda de {N}.|{N} (sala 12) tem os planos.
Обратитесь к секретарю, его зовут {R}.|{R} сказал, что крышу починят.|Письмо написала {R}.|Мы говорили с секретарём, это {R}.|Имя: {R}|Автор: {R}|Уважаемый {R}, спасибо за посылку.|{R} работает на мельнице.|Вчера {R} пришла поздно.|Наш сосед {R} держит собак.|Ключи у {R}.|Это {R} (комната 12).|Позвоните, {R} ждёт.|В кабинете {R} смотрит почту.
اتصل بالسيد {A} في المكتب.|قال {A} إن السقف سيصلح.|كتب الرسالة {A} في الربيع.|الاسم: {A}|المؤلف: {A}|عزيزي {A}، شكرا على الطرد.|{A} يعمل في المطحنة.|وصل {A} متأخرا أمس.|جارنا {A} عنده كلبان.|تحدثنا مع السيدة {A} يوم الاثنين.|قدم {A} جواز السفر.|المفاتيح عند {A} في الطابق.|هذا {A} (غرفة 12).|وجدت الملف على مكتب {A}.|طلب {A} نسخة.|وافق {A} على الشروط.
"""
#: Sentences without one; {X} is a place, a firm or another thing with capitals.
WITHOUT = """
The train to {X} leaves at nine.|We live near {X}.|{X} opened a second shop.|{X} is closed on Sundays.|The offices of {X} were sold.|Turn left at {X} and go on.|A ticket from {X} costs four pounds.|The {X} was signed in spring.|In {X} the snow lay deep.|He works for {X}.|See {X} for details.|Our report, {X}, was printed.|At {X} the river is wide.|Home Contact {X} News|Login Search Contact {X} : the plan of the town|Services Contact {X} About us|{X} signed the lease.|The minutes of {X} were sent.|Three boxes with {X} stood there.|The report by {X} is out.
Der Zug nach {X} fährt um neun.|Wir wohnen bei {X}.|{X} hat eine Filiale eröffnet.|Die Büros von {X} wurden verkauft.|In {X} lag Schnee.|Er arbeitet für {X}.|Der {X} wurde im Mai eröffnet.|Bitte {X} beachten.|Drei Kisten mit {X} standen da.|Kurz nach {X} begann der Regen.|Das Protokoll des {X} vom Mai.|Der Preis von {X} stieg.|Archiv Hilfe Kontakt {X} Suche|{X} unterschrieb den Vertrag.
Le train pour {X} part à neuf heures.|Nous habitons près de {X}.|{X} a ouvert un magasin.|Les bureaux de {X} sont vendus.|À {X} il neige.|Il travaille pour {X}.|La {X} est fermée.|Le procès-verbal du comité de {X} est prêt.|{X} a signé le contrat.|Aide Contact {X} Accueil
El tren a {X} sale a las nueve.|Vivimos cerca de {X}.|{X} abrió otra tienda.|Las oficinas de {X} se vendieron.|En {X} nieva.|Trabaja para {X}.|La {X} está cerrada.
O comboio para {X} parte às nove.|Vivemos perto de {X}.|{X} abriu outra loja.|Os escritórios de {X} foram vendidos.|Em {X} neva.|Trabalha para {X}.|A {X} está fechada.
Поезд в {Y} уходит в девять.|Мы живём возле {Y}.|{Y} открыл магазин.|В {Y} выпал снег.|Он работает в {Y}.|Улица {Y} закрыта.
القطار إلى {B} يغادر في التاسعة.|نسكن قرب {B}.|افتتح متجر {B} أمس.|في {B} سقط الثلج.|من {B} إلى النهر.|عند {B} يتسع النهر.|يوم {B} جميل.
"""
_SOUNDS = ("bra cel dor fen gal har jun kel lor mar nev pol quin ras sal tor ulm ves wil yar".split(), "an den ford gart hold ing kov lis mund net ond peck rin stad tel ven wick zer".split())


def _training(seed: int = 11, rounds: int = 14):
    """Sentences with their candidates' truth: ``text, start and end of the name or None``."""
    rng = random.Random(seed)
    made = lambda k=2: "".join(rng.choice(_SOUNDS[0] if not i else _SOUNDS[1]) for i in range(k)).capitalize()
    cyr = lambda: rng.choice("Бра Вель Гор Дан Зар Кел Лип Мор Рос Тар".split()) + rng.choice("ан ев ил ол ун".split()) + rng.choice("ов ин ова ина ский ская ко".split())
    ara = lambda: "ال" + "".join(rng.choice("بتجحدرزسشصطعفقكلمنهي") for _ in range(rng.randint(3, 5))) + rng.choice(["ي", "اني", "اوي", ""])
    plain = "حجر ورق باب نهر سوق بيت طريق جبل حقل ساحة مدرسة محطة كتاب شجرة صباح مساء قديم جديد كبير صغير شمالي غربي".split()

    def latin() -> str:
        pool = GIVEN[rng.randint(0, 1)]
        given = rng.choice(pool) if rng.random() < 0.75 else made()
        family = made(rng.randint(2, 3))
        return rng.choice([f"{given} {family}"] * 6 + [f"{given} {rng.choice('ABCDEGHJKLMPRST')}. {family}", f"{family}, {given}", f"{rng.choice('ABCDEFGHJKLMNPRSTW')}. {family}", f"{rng.choice('ABCDEFGHIJKLMNOPRSTUW')}. {family}", f"{given} {rng.choice(['de', 'von', 'van', 'da', 'del'])} {family}", f"{rng.choice(pool)} {rng.choice(pool)} {family}", f"{family.upper()}, {given}"])

    def thing() -> str:
        kind = rng.choice(sorted(w for w in THINGS if w.isascii())).capitalize()
        own = rng.choice(GIVEN[rng.randint(0, 1)]) if rng.random() < 0.25 else made(rng.randint(2, 3))
        return rng.choice([f"{own} {kind}", f"{own} {made()} {kind}", f"{kind} {own}", f"{kind} {own} {made()}", f"{rng.choice(['North', 'Old', 'New', 'Upper', 'Saint', 'Bad', 'Port', 'Santa', 'San'])} {made()}", f"{made()} {made()}", f"{rng.choice('ABCDEFGH')}. {rng.choice(['Introduction', 'Results', 'Appendix', 'Method', 'Summary', 'Scope', 'Terms'])}", f"{made()}, {made()}", f"St. {made()}", f"{rng.choice(sorted(w for w in COMMON if w.isascii())).capitalize()} {made()}"])

    def fill(frame: str):
        title = rng.choice(["", "", "", "Mr. ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Mme ", "M. ", "Sr. ", "Sra. ", "Prof. "])
        frame = frame.replace("{T}", title)
        for mark, make in (
            ("{N}", latin), ("{X}", thing),
            ("{R}", lambda: f"{rng.choice(GIVEN[rng.randint(2, 3)]) if rng.random() < 0.7 else cyr()} {cyr()}"), ("{Y}", lambda: f"{cyr()} {cyr()}"),
            ("{A}", lambda: f"{rng.choice(GIVEN[rng.randint(4, 5)]) if rng.random() < 0.8 else ara()} {ara()}"),
            ("{B}", lambda: f"{rng.choice(GIVEN[rng.randint(4, 5)]) if rng.random() < 0.25 else rng.choice(plain)} {rng.choice(plain)}"),
        ):
            at = frame.find(mark)
            if at >= 0:
                own = make()
                text = frame[:at] + own + frame[at + 3 :]
                return text, (at, at + len(own)) if mark in ("{N}", "{R}", "{A}") else None
        return frame, None

    for _ in range(rounds):
        for block in (WITH_PERSON, WITHOUT):
            for frame in block.replace("\n", "|").split("|"):
                if frame:
                    yield fill(frame)


@lru_cache(maxsize=1)
def model() -> dict[str, float]:
    """Weights of the features, fitted by gradient descent on the training sentences."""
    rows, truth = [], []
    for text, span in _training():
        for x in _candidates(text):
            f = features(text, x)
            if f and (x[:2] == span or not span or x[1] <= span[0] or x[0] >= span[1]):  # parts of a name are neither
                rows.append(f)
                truth.append(x[:2] == span)
    seen: dict[str, int] = {}
    for row in rows:
        for f in set(row):
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, row in enumerate(rows):
        x[i, [index[f] for f in row if f in index]] = 1
    y, w, moment, scale = np.array(truth, np.float32), np.zeros(len(index), np.float32), 0.0, 0.0
    for step in range(1, 161):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + 3e-4 * w
        moment, scale = 0.9 * moment + 0.1 * gradient, 0.99 * scale + 0.01 * gradient**2
        w = w - 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    return {f: float(w[i]) for f, i in index.items()}


def find(s: str) -> list[tuple[int, int, float]]:
    """Start, end and score (above 0: more probably a name than not) of the persons' names of a text, titles left out."""
    weights, scored = model(), []
    for x in _candidates(s):
        f = features(s, x) if _worth(s, x) else None
        if f:
            score = sum(weights.get(k, 0.0) for k in f)
            if score > 0:
                scored.append((x[2] == "three", score, _untitled(s, x[0], x[1]), x[1]))
    kept: list[tuple[int, int, float]] = []
    for _, score, a, b in sorted(scored, key=lambda v: (not v[0], -v[1], v[2] - v[3])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, score))
    return sorted(kept)
