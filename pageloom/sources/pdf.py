"""PDF files with a text layer: written page by page, and read for pages, boxes and text.

The writer keeps one page in memory. The reader knows what the writer makes and
other plain files: objects outside object streams, texts in Flate or plain
streams with literal or hexadecimal strings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

PRODUCER = "pageloom"


class PdfWriter:
    """Writes pages one after another to a binary file."""

    def __init__(self, file) -> None:
        self.file, self.at, self.kids, self.size = file, {}, [], 0
        self._write(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
        self.next = 4

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def _object(self, number: int, body: bytes) -> None:
        self.at[number] = self.size
        self._write(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    def page(self, text: str, width: float = 595.0, height: float = 842.0, rgb: bytes | None = None, shape: tuple[int, int] = (0, 0)) -> None:
        """A page: invisible text, over an image that fills it if there is one."""
        lines = [f"T* <{line.encode('utf-16-be', 'surrogatepass').hex()}> Tj" for line in text.split("\n")]
        body = b""
        resources = b"/Font << /F1 3 0 R >>"
        if rgb is not None:
            image, self.next = self.next, self.next + 1
            packed = zlib.compress(rgb)
            self._object(image, b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (shape[1], shape[0], len(packed)) + packed + b"\nendstream")
            resources += b" /XObject << /I1 %d 0 R >>" % image
            body = b"q %.2f 0 0 %.2f 0 0 cm /I1 Do Q\n" % (width, height)
        body += b"BT /F1 8 Tf 3 Tr 10 TL 30 %.2f Td\n" % (height - 20) + "\n".join(lines).encode() + b"\nET"
        packed = zlib.compress(body)
        content, page, self.next = self.next, self.next + 1, self.next + 2
        self._object(content, b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream")
        self._object(page, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << %s >> >>" % (width, height, content, resources))
        self.kids.append(page)

    def close(self) -> int:
        """Write the catalogue; the size of the file."""
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        self._object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.kids), b" ".join(b"%d 0 R" % k for k in self.kids)))
        self._object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
        info, self.next = self.next, self.next + 1
        self._object(info, b"<< /Producer (%s) >>" % PRODUCER.encode())
        start = self.size
        self._write(b"xref\n0 %d\n0000000000 65535 f \n" % self.next + b"".join(b"%010d 00000 n \n" % self.at[n] for n in range(1, self.next)))
        self._write(b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self.next, info, start))
        return self.size


_OBJECT = re.compile(rb"(?<!\d)(\d+) (\d+) obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"<([0-9A-Fa-f\s]*)>\s*Tj|\(((?:\\.|[^\\()])*)\)\s*Tj|(T\*|Td|TD)")


def _text(stream: bytes) -> str:
    out = []
    for hexed, plain, step in _SHOWN.findall(stream):
        if step:
            out.append("\n")
        elif hexed:
            out.append(bytes.fromhex(hexed.decode()).decode("utf-16-be", "replace"))
        else:
            out.append(re.sub(rb"\\(.)", rb"\1", plain).decode("latin-1"))
    return "".join(out).strip("\n")


def read_pages(content: bytes) -> Iterator[tuple[int, float, float, str]]:
    """``page, width, height, text`` of each page; nothing for a file that can't be read."""
    objects = {int(n): body for n, _, body in _OBJECT.findall(content or b"")}
    order = [int(k) for body in objects.values() if re.search(rb"/Type\s*/Pages\b", body) for k in re.findall(rb"(\d+) 0 R", (re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL) or [b"", b""])[1])]
    for page, number in enumerate([k for k in order if re.search(rb"/Type\s*/Page\b", objects.get(k, b""))], 1):
        body = objects[number]
        box = [float(x) for x in (re.search(rb"/MediaBox\s*\[(.*?)\]", body) or [b"", b"0 0 0 0"])[1].split()]
        parts = []
        for ref in re.findall(rb"(\d+) 0 R", (re.search(rb"/Contents\s*(\[.*?\]|\d+ 0 R)", body, re.DOTALL) or [b"", b""])[1]):
            own = objects.get(int(ref), b"")
            stream = _STREAM.search(own)
            try:
                parts.append(_text(zlib.decompress(stream[1]) if b"FlateDecode" in own else stream[1]) if stream else "")
            except (zlib.error, ValueError):
                parts.append("")
        yield page, box[2] - box[0], box[3] - box[1], "\n".join(parts)
