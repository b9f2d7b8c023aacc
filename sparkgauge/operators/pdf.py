"""How many pages PDF files have: read from the cross-reference data of each file, in tasks, a file at a time.

A file says at its end where its newest cross-reference section lies; sections of earlier saves are found from there.  They
name the catalogue, which names the root of the page tree, which holds the number.  Tables, streams and object streams are read;
a file whose sections don't lead to the catalogue is searched for its objects, of which the last of each number counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a compressed stream may unfold to: more is refused, so a small file can't fill a task's memory.
MOST_UNFOLDED = 256 << 20
_SPACE, _STOP = b" \t\n\r\x0c\x00", b" \t\n\r\x0c\x00()<>[]{}/%"
_OBJECT = re.compile(rb"(?<!\d)(\d+)[ \t\r\n]+(\d+)[ \t\r\n]+obj\b")
_TOKEN = re.compile(rb"[^ \t\n\r\x0c\x00()<>\[\]{}/%]+")


class Ref(int):
    """The number of an object."""


class Broken(ValueError):
    """No page count can be read."""


class Reader:
    """Values of a PDF's syntax, from a place on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            c = data[self.at]
            if c == 0x25:  # a comment
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(data))
            elif c in _SPACE:
                self.at += 1
            else:
                return

    def value(self, depth: int = 0):
        if depth > 100:
            raise Broken("nested too deep")
        self.skip()
        data, at = self.data, self.at
        if data.startswith(b"<<", at):
            self.at += 2
            out = {}
            while True:
                self.skip()
                if self.data.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, str):
                    raise Broken("a dictionary's key is no name")
                out[key] = self.value(depth + 1)
        if data.startswith(b"[", at):
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.data.startswith(b"]", self.at):
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if data.startswith(b"(", at):
            return self._text()
        if data.startswith(b"<", at):
            self.at = data.index(b">", at) + 1
            return data[at + 1 : self.at - 1]
        if data.startswith(b"/", at):
            found = _TOKEN.match(data, at + 1)
            self.at = found.end() if found else at + 1
            return re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), data[at + 1 : self.at].decode("latin-1"))
        return self._word()

    def _text(self) -> bytes:
        at, open_ = self.at + 1, 1
        while open_:
            if at >= len(self.data):
                raise Broken("a string has no end")
            c = self.data[at]
            open_ += (c == 0x28) - (c == 0x29)
            at += 2 if c == 0x5C else 1
        out, self.at = self.data[self.at + 1 : at - 1], at
        return out

    def _word(self):
        found = _TOKEN.match(self.data, self.at)
        if not found:
            raise Broken(f"no value at {self.at}")
        word, self.at = found[0], found.end()
        if re.fullmatch(rb"[+-]?\d+", word):
            ref = re.compile(rb"[ \t\r\n\x0c\x00]+(\d+)[ \t\r\n\x0c\x00]+R(?![A-Za-z0-9])").match(self.data, self.at)
            if ref:
                self.at = ref.end()
                return Ref(word)
            return int(word)
        if re.fullmatch(rb"[+-]?\d*\.\d*", word):
            return float(word) if any(48 <= c <= 57 for c in word) else 0.0
        return {b"true": True, b"false": False, b"null": None}.get(word, word)


def _unfold(raw: bytes) -> bytes:
    unfold = zlib.decompressobj()
    try:
        out = unfold.decompress(raw, MOST_UNFOLDED)
    except zlib.error as e:
        raise Broken(f"stream: {e}") from None
    if unfold.unconsumed_tail:
        raise Broken("a stream unfolds to too much")
    return out


def _rows(data: bytes, columns: int, bits: int) -> bytes:
    """Undo the predictors of PNG: each row begins with its kind."""
    step, wide = max(1, bits // 8), columns + 1
    out, before = bytearray(), bytes(columns)
    for at in range(0, len(data) - columns, wide):
        kind, row = data[at], bytearray(data[at + 1 : at + wide])
        for i, x in enumerate(row):
            left, up = row[i - step] if i >= step else 0, before[i]
            corner = before[i - step] if i >= step else 0
            if kind == 4:
                near = left + up - corner
                add = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (x + add) & 255
        out += row
        before = bytes(row)
    return bytes(out)


class Document:
    """The objects of a file, found through its cross-reference sections."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, tuple[int, int] | int] = {}
        self.trailer: dict = {}
        self.unfolded: dict[int, list[tuple[int, int, bytes]]] = {}

    def stream(self, at: int) -> tuple[dict, bytes]:
        """The object at a place: its dictionary and, unfolded, its stream."""
        reader = Reader(self.data, at)
        if not (found := _OBJECT.match(self.data, at)):
            raise Broken(f"no object at {at}")
        reader.at = found.end()
        about = reader.value()
        if not isinstance(about, dict):
            raise Broken("a stream without a dictionary")
        begin = re.compile(rb"[ \t\r\n\x0c\x00]*stream(\r\n|\n|\r)").match(self.data, reader.at)
        if not begin:
            raise Broken("no stream")
        length = about.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        end = begin.end() + length if isinstance(length, int) and length >= 0 else -1
        if not re.compile(rb"[ \t\r\n]*endstream").match(self.data, end if end >= 0 else 0):
            end = self.data.find(b"endstream", begin.end())
        raw = self.data[begin.end() : end]
        filters = about.get("Filter") or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name not in ("FlateDecode", "Fl"):
                raise Broken(f"filter {name}")
            raw = _unfold(raw)
        how = about.get("DecodeParms") or {}
        how = how[0] if isinstance(how, list) and how else how
        if isinstance(how, dict) and how.get("Predictor", 1) >= 10:
            raw = _rows(raw, max(1, how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8), how.get("Colors", 1) * how.get("BitsPerComponent", 8))
        return about, raw

    def sections(self) -> None:
        """All cross-reference sections, the newest first; what an older one says of an object doesn't count."""
        starts = list(re.finditer(rb"startxref[ \t\r\n]+(\d+)", self.data))
        if not starts:
            raise Broken("no cross-reference")
        todo, seen = [int(starts[-1][1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            reader = Reader(self.data, at)
            reader.skip()
            about = self._table(reader) if self.data.startswith(b"xref", reader.at) else self._stream(reader.at)
            for k, v in about.items():
                self.trailer.setdefault(k, v)
            todo += [about[k] for k in ("XRefStm", "Prev") if isinstance(about.get(k), int)]

    def _table(self, reader: Reader) -> dict:
        reader.at += 4
        while True:
            reader.skip()
            if self.data.startswith(b"trailer", reader.at):
                reader.at += 7
                about = reader.value()
                if not isinstance(about, dict):
                    raise Broken("trailer")
                return about
            first, n = reader.value(), reader.value()
            if not isinstance(first, int) or not isinstance(n, int):
                raise Broken("cross-reference table")
            for i in range(n):
                place, _, kind = reader.value(), reader.value(), reader.value()
                if kind == b"n":
                    self.places.setdefault(first + i, int(place))
                else:
                    self.places.setdefault(first + i, -1)

    def _stream(self, at: int) -> dict:
        about, raw = self.stream(at)
        if about.get("Type") != "XRef" or not isinstance(about.get("W"), list):
            raise Broken("cross-reference stream")
        wide = [int(w) for w in about["W"]]
        spans = about.get("Index") or [0, about.get("Size", 0)]
        at, row = 0, sum(wide)
        for first, n in zip(spans[::2], spans[1::2], strict=False):
            for i in range(n):
                cut, fields = at, []
                for w in wide:
                    fields.append(int.from_bytes(raw[cut : cut + w]) if w else None)
                    cut += w
                at += row
                if cut > len(raw):
                    return about
                kind = 1 if fields[0] is None else fields[0]
                self.places.setdefault(first + i, fields[1] if kind == 1 else (fields[1], fields[2] or 0) if kind == 2 else -1)
        return about

    def search(self) -> None:
        """Objects by their heads, for files whose sections are of no use."""
        self.places = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        for m in re.finditer(rb"trailer", self.data):
            try:
                about = Reader(self.data, m.end()).value()
            except (Broken, ValueError, IndexError):
                continue
            self.trailer |= about if isinstance(about, dict) else {}
        for number, at in list(self.places.items()):
            try:
                about, raw = self.stream(at)
            except (Broken, ValueError, IndexError, RecursionError):
                continue
            if about.get("Type") == "ObjStm":
                for i, n in enumerate(self._inside(number, about, raw)):
                    self.places.setdefault(n[0], (number, i))
            elif about.get("Type") == "XRef":
                self.trailer |= about

    def _inside(self, number: int, about: dict, raw: bytes) -> list[tuple[int, int, bytes]]:
        if number not in self.unfolded:
            reader, first = Reader(raw), about.get("First", 0)
            heads = [(reader.value(), reader.value()) for _ in range(int(about.get("N", 0)))]
            self.unfolded[number] = [(int(n), first + int(at), raw) for n, at in heads]
        return self.unfolded[number]

    def get(self, value):
        """What a reference stands for; other values as they are."""
        for _ in range(50):
            if not isinstance(value, Ref):
                return value
            place = self.places.get(int(value), -1)
            if isinstance(place, tuple):
                inside, i = place
                where = self.places.get(inside)
                if not isinstance(where, int) or where < 0:
                    raise Broken("object stream")
                found = self._inside(inside, *self.stream(where))
                value = Reader(found[i][2], found[i][1]).value() if i < len(found) else None
            elif place < 0 or not (head := _OBJECT.match(self.data, self._begin(place))):
                return None
            elif int(head[1]) != int(value):
                raise Broken("a cross-reference leads elsewhere")
            else:
                value = Reader(self.data, head.end()).value()
        raise Broken("references go round")

    def _begin(self, place: int) -> int:
        reader = Reader(self.data, place)
        reader.skip()
        return reader.at

    def pages(self) -> int:
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise Broken("no catalogue")
        tree = self.get(root.get("Pages"))
        if not isinstance(tree, dict):
            raise Broken("no page tree")
        n = self.get(tree.get("Count"))
        if not isinstance(n, int) or isinstance(n, bool) or n < 1:
            raise Broken("no number of pages")
        return n


def page_count(data: bytes) -> int:
    """Pages of a file's bytes; ``Broken`` if they can't be told."""
    problems = []
    for find in (Document.sections, Document.search):
        document = Document(data)
        try:
            find(document)
            return document.pages()
        except (Broken, ValueError, IndexError, TypeError, RecursionError) as e:
            problems.append(str(e))
    raise Broken("; ".join(problems))


def count_pages(documents: DataFrame) -> DataFrame:
    """``doc_class, doc, pages, fault`` of files (``doc_class, doc, content``); pages are null where they can't be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, faults = [], []
            for content in batch.column("content"):
                try:
                    pages.append(page_count(content.as_py() or b""))
                    faults.append(None)
                except Broken as e:
                    pages.append(None)
                    faults.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("doc_class"), batch.column("doc"), pa.array(pages, pa.int32()), pa.array(faults, pa.string())], names=["doc_class", "doc", "pages", "fault"])

    return documents.select("doc_class", "doc", "content").mapInArrow(run, "doc_class string, doc string, pages int, fault string")
