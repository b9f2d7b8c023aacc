"""Operators that work on single texts: brute force, round trips, odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge.llm import encoding, exact_dedup, line_dedup, mixing, packing, secrets, sharding, token_files
from sparkgauge.llm.entries import vocabulary

from odd_rows import ODD

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def plain(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


# --- encoding --------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .,'\n\t|<>é 　\x00ſ1")), max_size=40), max_size=6))
def test_chunks_give_what_whole_texts_give(texts):
    for path, encoder in ((BYTE, encoding.byte_encoder(BYTE)), (WORD, encoding.word_encoder(WORD))):
        tok = encoder.tokenizer
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(raw, np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids, (path, text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b <|startoftext|>", "<|endoftext|>", "x<|startoftext|><|endoftext|>  y", "<|EndOfText|> z"])
def test_added_tokens_as_the_library_reads_them(text):
    for path, encoder in ((BYTE, encoding.byte_encoder(BYTE)), (WORD, encoding.word_encoder(WORD))):
        assert encoder.encode(["some text", text, "some more text"])[1] == plain(path, text).tobytes()
    assert 50256 in plain(BYTE, "a <|endoftext|> b")


# --- token files -----------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.floats(0.5, 1.0))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(ids, percentile)) == ids).all()


@pytest.mark.parametrize("high", [1, 255, 256, 65_535, 65_536, 2**32])
def test_blocks_of_every_width(high):
    ids = np.random.default_rng(0).integers(0, high, 4096).astype(np.uint32)
    ids[7] = 2**32 - 1
    assert (token_files.unpack_block(token_files.pack_block(ids)) == ids).all()


def test_token_files(spark, wide, tmp_path):
    manifest = token_files.write_token_files(wide, BYTE, files=3, block_ids=128)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r, (_, text, _) in zip(got, rows, strict=True):
        ids = np.append(plain(BYTE, text), 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_kept_files_outlive_the_driver(spark, odd, empty, tmp_path):
    import subprocess
    import sys

    manifest = token_files.write_token_files(odd, BYTE, files=2, folder=f"{tmp_path}/out")
    mine = sorted(tuple(r) for r in token_files.read_token_files(manifest).collect() if r.doc_id == 10)
    again = token_files.read_manifest(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))
    # another process, without Spark
    code = f"""
import glob, sys
sys.path.insert(0, {str(__import__("pathlib").Path(token_files.__file__).parents[2])!r})
from sparkgauge.llm.token_files import TokenReader
n = 0
for f in sorted(glob.glob({f"{tmp_path}/out/*.ids"!r})):
    n += len(TokenReader(open(f, "rb")).documents)
print(n)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) == len(ODD)
    assert len(mine) == 1
    with pytest.raises(FileExistsError):
        token_files.write_token_files(odd, BYTE, folder=f"{tmp_path}/out")
    assert token_files.read_token_files(token_files.write_token_files(empty, BYTE)).count() == 0


def test_an_id_that_many_rows_share_is_split(spark):
    many = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    manifest = token_files.write_token_files(many, BYTE, files=4).collect()
    assert len(manifest) == 4
    assert max(r.documents for r in manifest) < 250


def test_random_access(tmp_path):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 500, 3, 129)]
    with (tmp_path / "x").open("wb") as f:
        w = token_files.TokenWriter(f, block_ids=64)
        for i, d in enumerate(docs):
            w.add(None if i == 0 else i, d)
        w.close()
    with (tmp_path / "x").open("rb") as f:
        reader = token_files.TokenReader(f)
        assert all((reader.document(i) == d).all() for i, d in enumerate(docs))
        assert np.concatenate(list(reader.read(100, 300))).tolist() == np.concatenate(docs)[100:400].tolist()


# --- packing ---------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20_000), max_size=60))
def test_packer(lengths):
    p = packing.HarmonicPacker()
    rows = [x for i, n in enumerate(lengths) for x in p.add(i, n)] + list(p.finish())
    for i, n in enumerate(lengths):
        at = 0
        for _, start, length, *_ in sorted(x for x in rows if x[0] == i):
            assert start == at
            at += length
        assert at == n
    bins: dict = {}
    for _, _, length, seq, offset in rows:
        assert offset == bins.get(seq, 0)
        bins[seq] = offset + length
    assert all(n <= 4096 for n in bins.values())
    waste = sum(4096 - n for n in bins.values() if n & (n - 1))
    assert waste <= 0.08 * sum(lengths) + 1


@given(st.integers(1, 100_000))
def test_cuts(n):
    out = packing.cut_lengths(n)
    assert sum(out) == n
    assert all(4096 // (4096 // x) == x for x in out[:-1])


def test_packing(spark, wide, empty):
    rows = packing.harmonic_pack(wide, WORD).collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole == Counter({k: sum(len(plain(WORD, t)) + 1 for i, t, _ in ODD if i == k) for k in {i for i, *_ in ODD}})
    ids = np.append(plain(WORD, ODD[8][1]), 2).astype("<u4")
    for r in rows:
        if r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.doc_tokens == len(ids)
    assert packing.harmonic_pack(empty, WORD).count() == 0


# --- secrets ---------------------------------------------------------------------------

KEY = "aB3dE5fG7hJ9kL2mN4pQ6rS8"
TEXTS = [
    "password = hunter2hunter2 and TOKEN:'abcdefghijklmnop'", "secret=short token=longenough12345", "token=password=abcdefghijkl", "secret=token: abcdefghijklmnop",
    "AKIA" + "Z" * 14 + " AKIAZ AKIA" + "A" * 13, "0123456789abcdef 0123456789abcde deadbeefdeadbeefdeadbeef", f"é漢 {KEY} end", "Api_Key: \"abc.def-ghi=jkl\"", None, "", "x" * 50,
    "550e8400-e29b-41d4-a716-446655440000", "path/to/some/file/that/is/long/enough", "passwd:  0123456789abcdef0123456789abcdef", "12345678901234567890123456789",
]


def brute_base(text):
    spans = []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(spans)


def brute_entropy(text, base, rules=secrets.EntropyRules()):
    out = []
    for m in re.finditer(rules.candidate, text):
        if any(a <= m.start() and m.end() <= b for a, _, b in base) or any(re.search(p, m[0]) for p in rules.allow):
            continue
        bits = next(b for _, p, b in rules.classes if re.search(p, m[0]))
        hits = []
        for i in range(len(m[0]) - rules.window + 1):
            c = Counter(m[0][i : i + rules.window])
            if -sum(n / rules.window * math.log2(n / rules.window) for n in c.values()) >= bits - 1e-9:
                hits.append(i)
        runs: list = []
        for i in hits:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + rules.window
            else:
                runs.append([i, i + rules.window])
        out += [(m.start() + a, 3, m.start() + b) for a, b in runs]
    return out


def test_secrets_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in secrets.secrets_digest(rows).collect():
        base = brute_base(TEXTS[r.doc_id] or "")
        show = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest(), TEXTS[r.doc_id]
        assert r.spans == show(base + brute_entropy(TEXTS[r.doc_id] or "", base)), TEXTS[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))


def test_every_class_and_separate_runs(spark):
    r = np.random.default_rng(4)
    pick = lambda chars, n: "".join(r.choice(list(chars), n))
    letters, digits, mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ABCDEFGHabcdefgh01234567+/"
    texts = [f"a {pick(letters, 42)} b", f"no {pick(digits, 40)}.", f"{pick(mixed, 30)}{'A' * 60}{pick(mixed, 30)}", "internationalisierungsvorschrift", "0" * 40, pick(mixed, 400)]
    texts += [pick(mixed, int(r.integers(20, 70))) + "a" * int(r.integers(0, 40)) + pick(digits, int(r.integers(0, 50))) for _ in range(40)]
    got = {x.doc_id: x for x in secrets.secrets_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert got[i].spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + brute_entropy(t, base))), t
    assert [got[i].n_entropy for i in range(5)] == [1, 0, 2, 0, 0]  # a run of digits is a base span already


def test_entropy_adds_and_suppresses(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    n = {r.doc_id: r.n_entropy for r in secrets.secrets_digest(rows).collect()}
    assert n[6] == 1
    assert all(n[i] == 0 for i in (8, 9, 10, 11, 12, 14))


def test_secrets_odd_inputs(wide, empty):
    assert secrets.find_secrets(wide).count() == len(ODD)
    assert secrets.secrets_digest(empty).count() == 0


# --- sharding --------------------------------------------------------------------------


def test_sharding(spark, wide, empty, tmp_path, monkeypatch):
    rows = sharding.shard_by_slots(wide, shards=3, slots=64).collect()
    assert len(rows) == len(ODD)
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sizes == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ODD)
    assert sharding.shard_by_slots(empty, 3, 64).count() == 0
    # a slot numbered in parts, the map's versions kept in a folder
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    same = spark.range(40).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).unionByName(wide.select("doc_id", "text"))
    rows = sharding.shard_by_slots(same, 3, 8, folder=f"{tmp_path}/map").collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    first, second = (sharding.load_map(spark, f"{tmp_path}/map", v) for v in (1, 2))
    assert (first.shards, second.shards) == (3, 4)
    assert all((r.shard, r.next_shard) == (first.of[r.vslot], second.of[r.vslot]) for r in rows)
    monkeypatch.undo()
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    loads = [r.b for r in sharding.shard_by_slots(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 40
    assert max(loads) <= 1.001 * min(loads)


def test_slot_map_versions(spark, tmp_path):
    weights = [int(w) for w in np.random.default_rng(3).integers(1, 1000, 500)]
    first = sharding.plan(weights, 8)
    grown = sharding.rebalance(first, weights, 9)
    assert (grown.version, max(grown.of)) == (2, 8)
    assert {grown.of[s] for s in grown.moved} == {8}
    assert max(grown.loads(weights)) < 1.05 * sum(weights) / 9
    shrunk = sharding.rebalance(grown, weights, 7)
    assert max(shrunk.of) < 7
    assert max(shrunk.loads(weights)) < 1.05 * sum(weights) / 7
    for m in (first, grown):
        sharding.save_map(spark, str(tmp_path), m)
    assert sharding.load_map(spark, str(tmp_path), 2).of == grown.of
    assert sharding.load_map(spark, str(tmp_path), 1).of == first.of
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(spark, str(tmp_path), first)


# --- exact duplicates ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_is_a_set(steps):
    index, live = exact_dedup.CuckooIndex(1), set()
    for add, i in steps:
        key = hashlib.sha256(bytes([i])).digest()
        if add and i not in live:
            index.insert(key, (i,))
            live.add(i)
        elif not add:
            assert index.delete(key) == (i in live)
            live.discard(i)
        assert len(index) == len(live)
    assert {v for _, (v,) in index.items()} == live
    assert all((hashlib.sha256(bytes([i])).digest() in index) == (i in live) for i in range(61))


def test_cuckoo_grows_and_verifies():
    index = exact_dedup.CuckooIndex(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for k in keys:
        index.insert(k, (1,))
    assert index.resized > 0
    assert all(k in index for k in keys)
    # same buckets and fingerprint, another key
    assert keys[0][:10] + b"x" * 22 not in index


def test_exact_dedup(spark, wide, empty):
    rows = exact_dedup.exact_dedup(wide).collect()
    assert len(rows) == len(ODD)
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1}
    by = {}
    for i, t, _ in ODD:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        by.setdefault(key, []).append((-len(t or ""), i is None, i))
    for r in rows:
        assert r.group_size == len(by[r.text_sha256])
        assert r.keep_id == min(by[r.text_sha256])[2]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_index_versions(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    one = exact_dedup.update_index(spark, None, f"{tmp_path}/1", table((1, "a b"), (2, "ab"), (3, "c"), (4, "d")))
    assert sorted((r.keep_id, r.group_size) for r in one.collect()) == [(1, 2), (3, 1), (4, 1)]
    two = exact_dedup.update_index(spark, f"{tmp_path}/1", f"{tmp_path}/2", table((5, "a  b"), (6, "e"), (7, "c")), table((3, " c"), (9, "never there")))
    assert sorted((r.keep_id, r.group_size) for r in two.collect()) == [(4, 1), (5, 3), (6, 1), (7, 1)]
    assert one.count() == 3


# --- line dedup ------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark):
    r = np.random.default_rng(5)
    pool = [f"line number {i} with words enough to be a window" for i in range(30)] + ["short", "tiny line", "x"]
    docs = [(i, "\n".join(r.choice(pool + [f"own line {i}.{k}, unlike all of the others" for k in range(20)] + [""], 12))) for i in range(60)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = set()
    for i, t in docs:
        lines = t.split("\n")
        for k, line in enumerate(lines):
            repeat = line.strip() in seen
            if line.strip():
                seen.add(line.strip())
            if k in got[i].deleted:
                assert repeat
            elif repeat:
                # guaranteed: lines that are windows of their own
                assert len(line) < line_dedup.WINDOW_CHARS
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in got[i].deleted)


def test_short_lines_go_in_runs(spark):
    run = ["a b c", "d e f", "g h i", "j k l", "m n o", "p q r", "s t u", "v w x"]
    docs = [(1, "\n".join(["head one is here and it is long enough", *run])), (2, "\n".join([*run, "foot two is here and it is long enough"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    assert got[2] == "foot two is here and it is long enough"


def repeated_runs(docs, w=line_dedup.WINDOW_CHARS):
    """Brute force: per doc_id the lines in runs of w characters, or in whole texts, that stand earlier too."""
    texts = [(i, [(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()]) for i, t in sorted(docs)]
    out = {i: set() for i, _ in docs}
    for at, (i, later) in enumerate(texts):
        for other, (_, first) in enumerate(texts[: at + 1]):
            for shift in range(-len(first) + 1, len(later)):
                if other == at and shift <= 0:
                    continue
                run = []
                for p in range(max(0, shift), min(len(later), len(first) + shift) + 1):
                    if p < min(len(later), len(first) + shift) and later[p][1] == first[p - shift][1]:
                        run.append(p)
                        continue
                    if run and (sum(len(later[q][1]) for q in run) >= w or len(run) == len(later) == len(first)):
                        out[i] |= {later[q][0] for q in run}
                    run = []
    return out


def test_a_short_shared_line_alone_is_no_run(spark):
    low = next(f"l{i}." for i in range(10_000) if hashlib.md5(f"l{i}.".encode()).hexdigest().startswith("000"))
    docs = [(i, f"the first line of text {i} is its own\n{low}\nand the last line of text {i} as well") for i in range(4)]
    docs += [(10, "q\nab"), (11, "q\nab"), (12, "q\nabc"), (13, low)]
    docs += [(20, f"{low}\nten of them\nand ten more and"), (21, f"x\n{low}\nten of them\nand ten more and\ny")]
    got = {r.doc_id: set(r.deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(not got[i] for i in (0, 1, 2, 3, 10, 12, 13, 20))
    assert got[11] == {0, 1}
    wanted = repeated_runs(docs)
    assert all(got[i] <= wanted[i] for i in got)


def test_runs_behind_a_common_line(spark):
    hot = [f"a common line {k} that text 0 has first of all" for k in range(2)]
    docs = [(0, "\n".join(hot)), (1, f"{hot[0]}\nshort\n{hot[1]}\ntail\nown 1"), (2, f"x\n{hot[0]}\nshort\n{hot[1]}\ntail\nown 2")]
    docs += [(3, "20 characters in all\n5 now\nand 20 more in here."), (4, "y\n20 characters in all\n5 now\nand 20 more in here.\nz")]
    r = np.random.default_rng(7)
    pool = ["In.", "x", "}", "a few words", "some twenty letters.", "nearly thirty letters in here", *hot, "", " In. "]
    docs += [(10 + i, "\n".join(r.choice(pool, int(r.integers(1, 9))))) for i in range(80)]
    docs += [(200, "q"), (201, "q"), (202, "q\nq"), (203, " ")]
    got = {r.doc_id: set(r.deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == {1, 2, 3, 4}
    assert got == repeated_runs(docs)


def test_line_dedup_odd_inputs(wide, empty):
    rows = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(wide).collect()}
    assert (3, None) in rows
    assert (4, "") in rows
    assert (9, "another beginning of a page, quite unlike\n\nlast") in rows
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(wide).columns.count("deleted") == 1


# --- mixing ----------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_mix(spark):
    r = np.random.default_rng(2)
    docs = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(r.integers(0, 60, 3000), r.choice(["a", "b", "c", "d", None], 3000, p=[0.6, 0.2, 0.1, 0.09, 0.01]), strict=True))]
    docs = [(i, t, None if s is None or s == "None" else str(s)) for i, t, s in docs]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes, taken = Counter(), Counter()
    for x in rows:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert x.taken <= 3 * x.size
        assert x.copies <= 3
    for s, t in brute_targets(sizes).items():
        assert all(x.target == pytest.approx(t) for x in rows if x.source == s)
        assert abs(taken[s] - t) <= 60
        assert {x.source_size for x in rows if x.source == s} == {sizes[s]}
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert {(x.doc_id, x.taken) for x in again} == {(x.doc_id, x.taken) for x in rows}


def brute_multiplier(sizes, target, most=3):
    """The root of a monotone function by bisection."""
    low, high = -50.0, 50.0
    for _ in range(200):
        a = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (a, high) if (sizes * np.minimum(most, np.exp(a * sizes))).sum() < target else (low, a)
    return a


def test_rates_are_tilted_and_solve_the_dual(spark):
    r = np.random.default_rng(5)
    groups = {k: r.integers(1, 900, n) for k, n in (("a", 400), ("b", 50), ("c", 3), ("d", 80), ("e", 1))}
    docs = [(i, " ".join(["w"] * int(n)), k) for i, (k, n) in enumerate((k, n) for k, v in groups.items() for n in v)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    grown = shrunk = 0
    for k, sizes in groups.items():
        own = sorted((x for x in rows if x.source == k), key=lambda x: x.size)
        target, rates = own[0].target, np.array([x.rate for x in own])
        assert sum(x.rate * x.size for x in own) == pytest.approx(target, rel=1e-6)
        if target < 3 * sizes.sum() - 1e-6:
            a = brute_multiplier(sizes.astype(float), target)
            assert rates == pytest.approx(np.minimum(3, np.exp(a * np.array([x.size for x in own]))), rel=1e-5)
        grown += len(set(rates[rates < 3])) > 1 and a > 0
        shrunk += len(set(rates)) > 1 and a < 0
        # what is left below the target has no room for any document that may be taken once more
        left = target - sum(x.taken for x in own)
        assert all(x.size > left for x in own if x.size and x.copies <= x.rate - 1e-6)
        assert -left < max(x.size for x in own)
    assert grown and shrunk


def brute_fill(rows, gap):
    left, out = gap, {}
    for size in sorted({s for s, _ in rows}, reverse=True):
        for again in sorted({a for s, a in rows if s == size}):
            n = sum((s, a) == (size, again) for s, a in rows)
            if n * size > left:
                break
            left -= n * size
            out[size] = again
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0.1, 0.2, 0.3, 0.4])), min_size=1, max_size=30), st.integers(0, 80))
def test_fill_takes_the_largest_that_fit(rows, gap):
    import pandas as pd

    got = mixing.fill(pd.DataFrame({"k": "0a", "size": [s for s, _ in rows], "again": [a for _, a in rows], "gap": float(gap)}))
    expected = brute_fill(rows, gap)
    assert dict(zip(got["size"], got["top"], strict=True)) == expected
    assert sum(got["tokens"]) == sum(s for s, a in rows if a <= expected.get(s, 0))


def test_mix_odd_inputs(wide, empty):
    rows = mixing.mix(wide.drop("size", "taken", "copies")).collect()
    assert len(rows) == len(ODD)
    assert mixing.mix(empty).count() == 0
    taken = mixing.apply_mix(wide)
    assert taken.columns == wide.columns
    assert mixing.apply_mix(empty).count() == 0
    # names that the operator uses itself pass through with their values
    names = ["k", "a", "u", "v", "base", "cut", "gap", "row", "_row", "again", "fills", "Size", "n", "a.b"]
    odd = wide.select("doc_id", "text", "source", *[wide.doc_id.alias(c) for c in names])
    for out in (mixing.mix(odd), mixing.apply_mix(odd)):
        for r in out.collect():
            assert all(r[c] == r.doc_id for c in names if c in out.columns)
    assert mixing.apply_mix(odd).columns == odd.columns
