import hashlib
import json
import zlib
from pathlib import Path

import pytest

from sparkgauge import cli
from sparkgauge.operators import pdf
from sparkgauge.plans import corpus
from sparkgauge.sources import discovery, store
from sparkgauge.sources.jsonl import InputError

KIND = "inv"


def plain_pdf(pages: int, root: int = 1) -> bytes:
    """A file with a cross-reference table."""
    kids = " ".join(f"{3 + i} 0 R" for i in range(pages))
    bodies = [f"<< /Type /Catalog /Pages {root + 1} 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {pages} >>", *[f"<< /Type /Page /Parent {root + 1} 0 R /Note (a \\) b) >>"] * pages]
    out, places = b"%PDF-1.4\n% \xff\n", []
    for i, b in enumerate(bodies):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n{b}\nendobj\n".encode()
    at = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + f"trailer\n<< /Size {len(bodies) + 1} /Root {root} 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()


def saved_again(data: bytes, pages: int) -> bytes:
    """The same with its page tree replaced by a later save."""
    before = data.rindex(b"startxref")
    old = int(data[before + 9 :].split()[0])
    place = len(data)
    data += f"2 0 obj\n<< /Type /Pages /Kids [] /Count {pages} >>\nendobj\n".encode()
    at = len(data)
    return data + f"xref\n2 1\n{place:010} 00000 n \ntrailer\n<< /Size 4 /Root 1 0 R /Prev {old} >>\nstartxref\n{at}\n%%EOF\n".encode()


def packed_pdf(pages: int, predictor: bool) -> bytes:
    """Catalogue and page tree in an object stream, found through a cross-reference stream."""
    a, b = b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {pages} /Kids [] >>".encode()
    heads = f"1 0 2 {len(a) + 1} ".encode()
    raw = zlib.compress(heads + a + b" " + b)
    out = b"%PDF-1.5\n"
    at_objects = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(heads), len(raw)) + raw + b"\nendstream\nendobj\n"
    at = len(out)
    rows = [bytes([0, 0, 0, 0]), bytes([2, 0, 3, 0]), bytes([2, 0, 3, 1]), bytes([1]) + at_objects.to_bytes(2) + bytes([0]), bytes([1]) + at.to_bytes(2) + bytes([0])]
    extra = b""
    if predictor:
        before, coded = bytes(4), []
        for r in rows:
            coded.append(bytes([2, *[(x - y) & 255 for x, y in zip(r, before, strict=True)]]))
            before = r
        rows, extra = coded, b"/DecodeParms << /Predictor 12 /Columns 4 >>"
    raw = zlib.compress(b"".join(rows))
    out += b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode %s >>\nstream\r\n" % (len(raw), extra) + raw + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % at


def test_page_counts():
    for n in (1, 9, 40):
        assert pdf.page_count(plain_pdf(n)) == n
        assert pdf.page_count(packed_pdf(n, False)) == pdf.page_count(packed_pdf(n, True)) == n
        assert pdf.page_count(saved_again(plain_pdf(n), n + 2)) == n + 2
        # sections that lead nowhere: objects are searched for
        assert pdf.page_count(plain_pdf(n).replace(b"startxref\n", b"startxref\n9")) == n
        assert pdf.page_count(packed_pdf(n, True).rpartition(b"startxref")[0]) == n
    assert pdf.page_count(plain_pdf(3).replace(b"/Count 3", b"/Count 9 0 R").replace(b"xref\n0", b"9 0 obj 7 endobj\nxref\n0", 1)) == 7
    bad = [b"", b"%PDF", plain_pdf(2).replace(b"/Count 2", b"/Count 0"), plain_pdf(2).replace(b"/Root", b"/Boot"), b"[" * 100_000, packed_pdf(2, False)[:60]]
    for data in bad:
        with pytest.raises(pdf.Broken):
            pdf.page_count(data)


def test_a_small_file_does_not_unfold_to_gigabytes(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_UNFOLDED", 1000)
    with pytest.raises(pdf.Broken, match="too much"):
        pdf._unfold(zlib.compress(bytes(5000)))


FIELDS = {
    "alpha.v2": {"/vendor": {"state": "present", "value": "A / B é"}, "/tax": {"state": "missing"}, "/items/0/name": {"state": "present", "value": {"b": 1, "a": [2.5, None]}}},
    "beta": {"/vendor": {"state": "present", "value": 12}, "/tax": {"state": "null"}, "/items/0/price": {"state": "missing"}},
    "other": {"/unused": {"state": "missing"}},
}


def split(top: Path, kind: str = KIND, pages: tuple = (("alpha.v2.pdf", 9), ("beta.PDF", 1))) -> dict[str, str]:
    for d in ("source", "split", "manifests"):
        (top / d).mkdir(exist_ok=True)
    for d in ("source", "split"):
        (top / d / kind).mkdir(exist_ok=True)
    rows = {d: {"doc": d, "docClass": kind, "fields": f} for d, f in FIELDS.items()}
    put = lambda path, rows: path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    named = {"alpha.v2": "alpha.v2.pdf", "beta": "beta.pdf"}
    put(top / "source" / kind / "golden.jsonl", rows.values())
    put(top / "split" / kind / "golden.jsonl", [rows["beta"], rows["alpha.v2"] | {"doc": "alpha.v2.pdf"}])
    for name, n in pages:
        (top / "split" / kind / name.replace(".PDF", ".pdf")).write_bytes(plain_pdf(n))
    assert set(named.values()) == {n.replace(".PDF", ".pdf") for n, _ in pages}
    seal(top, kind)
    return {"source": str(top / "source"), "cal-test": str(top / "split"), "manifests": str(top / "manifests")}


def seal(top: Path, kind: str = KIND) -> None:
    digest = hashlib.sha256((top / "split" / kind / "golden.jsonl").read_bytes()).hexdigest()
    (top / "manifests" / f"{kind}.manifest.json").write_text(json.dumps({"class": kind, "calTestGoldenHash": digest}))


def verb(flags: dict, out: Path, *more: str) -> int:
    return cli.main(["corpora", *[x for k, v in flags.items() for x in (f"--{k}", v)], "--out", str(out), *more])


def test_a_build_publishes_all_of_it(spark, tmp_path, capsys):
    flags = split(tmp_path)
    split(tmp_path, "bill", (("alpha.v2.pdf", 2), ("beta.pdf", 12)))
    out = tmp_path / "out"
    assert verb(flags, out) == 0
    said = capsys.readouterr().out
    assert f"{KIND}: full 2 docs, 10 pages, 6 fields, 2 absent" in said
    assert "cap-confirmed primary: 2 docs, 3 pages, 6 fields, 2 absent" in said
    assert "  bill/beta.pdf: 12 pages, 3 fields, 1 absent" in said
    at = store.resolve(out)
    lines = [json.loads(x) for p in sorted((at / f"golden.{KIND}.jsonl").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"doc": f"{d}.pdf", "docClass": KIND, "schema": f"{KIND}.schema.json", "fields": FIELDS[d]} for d in ("alpha.v2", "beta")]
    assert [list(x["fields"]) for x in lines] == [list(FIELDS[d]) for d in ("alpha.v2", "beta")]
    counts = json.loads((at / "corpus-counts.json").read_text())
    assert counts["classes"][KIND] == {
        "full": {"documents": 2, "fields": 6, "goldenAbsentFields": 2, "pages": 10}, "atOrBelowPageLimit": {"documents": 1, "fields": 3, "goldenAbsentFields": 1, "pages": 1},
        "pageCounts": [{"doc": "alpha.v2.pdf", "pages": 9}, {"doc": "beta.pdf", "pages": 1}], "pageHistogram": {"1": 1, "9": 1},
        "conditionalExclusions": [{"docClass": KIND, "doc": "alpha.v2.pdf", "pages": 9, "fields": 3, "goldenAbsentFields": 1}],
    }
    assert counts["branches"] == {"capRemoved": {"documents": 4, "fields": 12, "goldenAbsentFields": 4, "pages": 24}, "capConfirmed": {"documents": 2, "fields": 6, "goldenAbsentFields": 2, "pages": 3}}
    assert [x["docClass"] for x in counts["conditionalExclusions"]] == ["bill", KIND]
    schema = json.loads((at / f"{KIND}.schema.json").read_text())
    assert schema["required"] == ["items", "tax", "vendor"]
    # what a build publishes is a corpus folder
    found = discovery.golden_files(out)
    assert [Path(p).name for p in found] == ["golden.bill.jsonl", f"golden.{KIND}.jsonl"]
    assert discovery.class_schemas(out)[KIND].name == f"{KIND}.schema.json"
    # the same inputs give the same bytes; the version before stays, older ones go
    first = json.loads((out / store.CURRENT).read_text())
    assert verb(flags, out, "--class", KIND, "--class", "bill", "--class", KIND) == 0
    second = json.loads((out / store.CURRENT).read_text())
    assert second["entries"] == first["entries"]
    assert second["before"] == first["version"]
    assert verb(flags, out, "--class", KIND) == 0
    assert sorted(p.name for p in out.glob("version-*")) == sorted([json.loads((out / store.CURRENT).read_text())["version"], second["version"]])


def spoil(top: Path, what: str) -> None:
    source, frozen = top / "source" / KIND / "golden.jsonl", top / "split" / KIND / "golden.jsonl"
    said = {p: [json.loads(x) for x in p.read_text().splitlines()] for p in (source, frozen)}
    put = lambda p, rows: p.write_text("".join(json.dumps(r) + "\n" for r in rows))
    if what == "hash":
        frozen.write_text(frozen.read_text() + "\n")
        return
    if what == "manifest":
        (top / "manifests" / f"{KIND}.manifest.json").write_text('{"class": "x"}')
        return
    if what == "no manifest":
        (top / "manifests" / f"{KIND}.manifest.json").unlink()
        return
    if what == "no files":
        for p in (top / "split" / KIND).glob("*.pdf"):
            p.unlink()
        return
    if what == "extra file":
        (top / "split" / KIND / "gamma.pdf").write_bytes(plain_pdf(1))
        return
    if what == "broken file":
        (top / "split" / KIND / "beta.pdf").write_bytes(b"%PDF-1.4 nothing")
        return
    rows = said[source]
    if what == "drift":
        rows[0]["fields"]["/tax"] = {"state": "null"}
    elif what == "order":
        rows[0]["fields"] = dict(reversed(rows[0]["fields"].items()))
    elif what == "class":
        rows[2]["docClass"] = "z"
    elif what == "suffix":
        rows[2]["doc"] = "other.PDF"
    elif what == "twice":
        rows.append(rows[2])
    elif what == "gone":
        del rows[1]
    elif what == "frozen twice":
        put(frozen, [*said[frozen], said[frozen][0] | {"doc": "beta.pdf"}])
    elif what == "frozen extra":
        put(frozen, [*said[frozen], rows[2]])
    elif what == "pointers":
        for p in (source, frozen):
            for r in said[p]:
                r["fields"] |= {"/tax/rate~2": {"state": "missing"}}
            put(p, said[p])
    elif what == "shapes":
        for p in (source, frozen):
            for r in said[p]:
                r["fields"] |= {"/tax/0": {"state": "missing"}}
            put(p, said[p])
    put(source, rows)
    seal(top)


@pytest.mark.parametrize(("what", "why"), [
    ("hash", "aren't those of the manifest"), ("manifest", "manifest without the class"), ("no manifest", "is missing"), ("no files", "PATH|no documents|does not"), ("extra file", "gamma.pdf: document without a"), ("broken file", "beta.pdf: no page count"),
    ("drift", "differ"), ("order", "differ"), ("class", "another class"), ("suffix", "names a file"), ("twice", "more than one source"), ("gone", "without a source"), ("frozen twice", "more than one frozen"),
    ("frozen extra", "frozen row without a document"), ("pointers", "wrong escape"), ("shapes", "extends a leaf"),
])
def test_a_fault_leaves_the_output_as_it_was(spark, tmp_path, capsys, what, why):
    import re

    flags, out = split(tmp_path), tmp_path / "out"
    (out / "version-0").mkdir(parents=True)
    (out / "version-0/golden.inv.jsonl").write_text("{}")
    (out / store.CURRENT).write_text('{"version": "version-0"}')
    before = {p: p.read_bytes() for p in sorted(out.rglob("*")) if p.is_file()}
    spoil(tmp_path, what)
    assert verb(flags, out) == 2
    assert re.search(why, capsys.readouterr().err)
    assert {p: p.read_bytes() for p in sorted(out.rglob("*")) if p.is_file()} == before


@pytest.mark.parametrize("step", ["goldens", "schema", "counts", "version", "current"])
def test_a_crash_publishes_nothing(spark, tmp_path, monkeypatch, step):
    flags, out = split(tmp_path), tmp_path / "out"
    places = corpus.Places(flags["source"], flags["cal-test"], flags["manifests"])
    write, rename = store.Store.write, store.Store.rename

    def crash(self, name, *rest):
        if (step == "schema" and name.endswith("schema.json")) or (step == "counts" and name == corpus.COUNTS) or (step == "current" and name == store.CURRENT):
            raise KeyboardInterrupt
        return write(self, name, *rest)

    def stop(self, name, to):
        if (step == "goldens" and to.startswith("golden.")) or (step == "version" and to.startswith("version-")):
            raise KeyboardInterrupt
        return rename(self, name, to)

    def attempt():
        with monkeypatch.context() as m:
            m.setattr(store.Store, "write", crash)
            m.setattr(store.Store, "rename", stop)
            with pytest.raises(KeyboardInterrupt):
                corpus.build(spark, places, str(out), pdf.count_pages)

    attempt()
    assert not (out / store.CURRENT).exists()
    with pytest.raises(InputError):
        discovery.golden_files(out)
    done = corpus.build(spark, places, str(out), pdf.count_pages)
    attempt()
    assert json.loads((out / store.CURRENT).read_text())["version"] == done["version"]
    assert len(discovery.golden_files(out)) == 1


def test_wrong_usage(spark, tmp_path):
    flags = split(tmp_path)
    assert verb(flags | {"class": "../x"}, tmp_path / "o") == 2
    assert cli.main(["corpora", "--source", flags["source"], "--out", str(tmp_path / "o")]) == 2
    assert cli.main(["corpora", "--out", str(tmp_path / "o")]) == 2
    pages = tmp_path / "pages.jsonl"
    pages.write_text("".join(json.dumps({"doc_class": KIND, "doc": d, "pages": 3}) + "\n" for d in ("alpha.v2.pdf", "beta.pdf")))
    assert verb(flags | {"pages": str(pages)}, tmp_path / "o") == 0
    assert json.loads((store.resolve(tmp_path / "o") / corpus.COUNTS).read_text())["classes"][KIND]["pageHistogram"] == {"3": 2}
