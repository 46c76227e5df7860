"""Rendering and recognition as replaceable parts that run inside Arrow batches.

Where the machine has the usual command-line tools, ``CommandRenderer`` and
``CommandRecogniser`` call them, with files passed through pipes. Without them
there are stand-ins: blank pages, and a reader of block digits, which really
reads pixels.
"""

from __future__ import annotations

import shutil
import subprocess
from typing import Protocol

import numpy as np


class Renderer(Protocol):
    """Makes a page's image."""

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray: ...


class ImageRecogniser(Protocol):
    """Reads the text of a page image in given packs; empty if it fails."""

    def read_image(self, rgb: np.ndarray, lang: str, dpi: int, psm: int) -> str: ...


def _to_pnm(rgb: np.ndarray) -> bytes:
    """An image as a binary portable anymap: gray if it has one plane."""
    kind = b"P6" if rgb.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + np.ascontiguousarray(rgb, np.uint8).tobytes()


def _from_pnm(data: bytes) -> np.ndarray:
    """The RGB image of a binary portable anymap."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while data[end : end + 1].strip():
            end += 1
        if end > at and data[at : at + 1] != b"#":
            fields.append(data[at:end])
            at = end + 1
        else:
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
    width, height, planes = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    plane = np.frombuffer(data, np.uint8, height * width * planes, at).reshape(height, width, planes)
    return plane if planes == 3 else np.repeat(plane, 3, axis=2)


class CommandRenderer:
    """Pages by a command that reads a PDF from its input and writes an anymap."""

    def __init__(self, command: str = "pdftoppm", seconds: int = 120) -> None:
        self.command, self.seconds = command, seconds

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        done = subprocess.run([self.command, "-r", str(dpi), "-f", str(page), "-l", str(page), "-"], input=content, capture_output=True, timeout=self.seconds, check=True)
        return _from_pnm(done.stdout)


class CommandRecogniser:
    """Texts by a command that reads an image from its input and writes text; a page that fails is empty."""

    def __init__(self, command: str = "tesseract", seconds: int = 300) -> None:
        self.command, self.seconds = command, seconds

    def read_image(self, rgb: np.ndarray, lang: str, dpi: int, psm: int) -> str:
        try:
            done = subprocess.run(
                [self.command, "stdin", "stdout", "-l", lang, "--dpi", str(dpi), "--psm", str(psm)], input=_to_pnm(rgb), capture_output=True, timeout=self.seconds, check=True
            )
        except (OSError, subprocess.SubprocessError):
            return ""
        return done.stdout.decode("utf-8", "replace")


def system_packs(command: str = "tesseract") -> list[str] | None:
    """The packs that the recogniser of this machine lists, without those that only describe a page; None if there is none."""
    if shutil.which(command) is None:
        return None
    try:
        done = subprocess.run([command, "--list-langs"], capture_output=True, timeout=60, check=True, text=True)
    except (OSError, subprocess.SubprocessError):
        return None
    lines = (done.stdout or done.stderr).splitlines()
    return sorted({x.strip() for x in lines if x.strip() and not x.rstrip().endswith(":")} - {"osd", "equ"})


#: Digits of five by seven blocks, row by row.
DIGITS = {
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00010 00100 01000 11111", "3": "11111 00010 00100 00010 00001 10001 01110",
    "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110", "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000",
    "8": "01110 10001 10001 01110 10001 10001 01110", "9": "01110 10001 10001 01111 00001 00010 01100",
}
_SHAPES = {k: np.array([[c == "1" for c in row] for row in v.split()]) for k, v in DIGITS.items()}


def drawn_digits(text: str, unit: int = 3, margin: int = 20, paper: int = 235, ink: int = 40) -> np.ndarray:
    """A page with lines of digits in blocks; what is no digit is a gap."""
    lines = text.split("\n")
    page = np.full((2 * margin + unit * 10 * len(lines), 2 * margin + unit * 6 * max(map(len, lines)), 3), paper, np.uint8)
    for k, line in enumerate(lines):
        for i, ch in enumerate(line):
            if ch in _SHAPES:
                shape = np.kron(_SHAPES[ch], np.ones((unit, unit), bool))
                y, x = margin + unit * 10 * k, margin + unit * 6 * i
                page[y : y + shape.shape[0], x : x + shape.shape[1]][shape] = ink
    return page


class DigitRecogniser:
    """Reads lines of block digits: rows and columns of ink are cut at gaps, and each piece is the digit that it differs least from."""

    def read_image(self, rgb: np.ndarray, lang: str, dpi: int, psm: int) -> str:
        luma = rgb.mean(axis=2) if rgb.ndim == 3 else rgb
        ink = luma < (float(luma.min()) + float(luma.max())) / 2
        if luma.max() - luma.min() < 60:
            return ""
        lines = []
        for top, bottom in _runs(ink.any(axis=1)):
            unit = (bottom - top) / 7
            columns = _runs(ink[top:bottom].any(axis=0))
            line, last = "", None
            for left, right in columns:
                # a narrow digit stands in the middle of its cell
                start = left - (5 * unit - (right - left)) / 2 if right - left < 4.5 * unit else left
                if last is not None and start - last > 8 * unit:
                    line += " "
                at = lambda n, low: (low + (np.arange(n) + 0.5) * unit).astype(int)
                cell = ink[np.clip(at(7, top), 0, ink.shape[0] - 1)][:, np.clip(at(5, start), 0, ink.shape[1] - 1)]
                line += min(_SHAPES, key=lambda k: int((cell != _SHAPES[k]).sum()))
                last = start
            lines.append(line)
        return "\n".join(lines)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def recogniser() -> ImageRecogniser:
    """The recogniser of this machine, or the reader of digits where there is none."""
    return CommandRecogniser() if capabilities()["tesseract"] else DigitRecogniser()


def renderer() -> Renderer:
    """The renderer of this machine, or blank pages where there is none."""
    return CommandRenderer() if capabilities()["pdftoppm"] else BlankRenderer()


class BlankRenderer:
    """A white page of A4 size."""

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        return np.full((round(dpi * 11.69), round(dpi * 8.27), 3), 255, np.uint8)


def capabilities() -> dict[str, bool]:
    """Which outside tools this machine has."""
    return {tool: shutil.which(tool) is not None for tool in ("tesseract", "pdftoppm")}


def missing_help(missing: list[str]) -> str:
    """What to do about tools that are missing."""
    return "All tools were found." if not missing else "Not found: " + ", ".join(sorted(missing)) + ". Install them with the system's package manager."
