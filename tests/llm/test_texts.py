"""Media, tiling, BPE, lines, preferences."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken
from helpers import AWKWARD, LONG, awkward, clashing, empty, rows

from gridleaf.llm import bpe, lines, media, preferences, tiling
from gridleaf.llm.common import WordHashes
from gridleaf.llm.queries import ORACLE_SQL, QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# Media


def test_chunks_cover_and_bound():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 1023, 1024, 1025, 9000, 90_000):
        data = rng.randbytes(n)
        parts = media.chunks(data)
        assert b"".join(parts) == data and all(len(p) <= media.MOST for p in parts) and all(len(p) >= media.LEAST for p in parts[:-1])
    assert max(map(len, media.chunks(bytes(70_000)))) == media.MOST


def test_cuts_follow_content():
    rng = random.Random(2)
    data = rng.randbytes(40_000)
    a, b = set(media.chunks(data)), set(media.chunks(b"inserted" + data))
    assert len(a & b) >= len(a) - 2


def plain_feature(samples):
    counts = [samples.count(bytes([b])) for b in range(256)]
    n = len(samples)
    return f"sum={sum(b * c for b, c in enumerate(counts))};energy={sum(b * b * c for b, c in enumerate(counts))};levels={sum(c > 0 for c in counts)};entropy={-sum(c / n * math.log2(c / n) for c in counts if c):.6f}"


def against_texts(found, texts, forms=False):
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded) and r["n_chunks"] == len(media.chunks(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        have, want = (x["feature"].rsplit("=", 1) for x in (r, {"feature": plain_feature(padded)}))
        assert have[0] == want[0] and abs(float(have[1]) - float(want[1])) < 2e-6
        if forms:
            data, n = media.opened(r["media"])
            assert data == padded and n == len(raw)
            assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_media_round_trip(spark):
    found = media.media_columns(clashing(spark), keep_media=True).collect()
    assert len(found) == len(AWKWARD)
    against_texts(found, {r[0]: r[1] for r in AWKWARD}, True)
    assert media.media_columns(empty(spark)).count() == 0


def test_media_query_in_plain_python(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["op3_media_columns"](spark, data).collect()
    assert len(found) == len(texts)
    against_texts(found, texts)
    again = rows(QUERIES["op3_media_columns"](spark, data))
    assert all(again[r["doc_id"]] == r for r in found)
    equal = {}
    for r in found:
        equal.setdefault(texts[r["doc_id"]] or "", set()).add((r["media_bytes"], r["media_sha256"]))
    assert all(len(v) == 1 for v in equal.values())


def test_chunks_are_shared(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    common = " ".join(rng.choice(words) for _ in range(4000))
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1500))) + common for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    heads = media.listed(docs)
    lists = {r["doc_id"]: [bytes(d) for d in r["list"]] for r in heads.collect()}
    store = {bytes(r["digest"]): bytes(r["z"]) for r in media.stored(docs).collect()}
    assert set(store) == {d for x in lists.values() for d in x} and len(store) < sum(map(len, lists.values())) / 2
    plain = media.zstandard.ZstdDecompressor()
    for i, t in texts.items():
        assert b"".join(media.verified(plain, d, store[d]) for d in lists[i]) == media.payload(t)[0]
    against_texts(media.media_columns(docs, keep_media=True).collect(), texts, True)


def test_store_holds_each_chunk_once(spark):
    store = media.stored(awkward(spark)).collect()
    assert len({bytes(r["digest"]) for r in store}) == len(store)
    z = media.zstandard.ZstdCompressor().compress
    form = media.container([(media.digest(b"abc"), z(b"abc"))], 3)
    assert media.opened(form) == (b"abc", 3)
    with pytest.raises(ValueError):
        media.opened(media.container([(media.digest(b"abc"), z(b"abd"))], 3))
    with pytest.raises(ValueError):
        media.opened(b"else" + form)


def test_stored_forms_do_not_depend_on_the_table(spark):
    text = "one text of its own " * 30
    forms = set()
    for n in (0, 3, 400):
        df = spark.createDataFrame([(0, text), *((i + 1, f"other words {i * i} " * (i % 90)) for i in range(n))], "doc_id long, text string")
        forms |= {(r.media_bytes, r.media_sha256) for r in media.media_columns(df).where("doc_id = 0").collect()}
    assert len(forms) == 1


def test_chunks_of_many_media(spark, monkeypatch):
    """A chunk that all media share is joined by a salt, with the same result."""
    rng = random.Random(2)
    common = bytes(rng.randrange(97, 123) for _ in range(40_000)).decode()
    texts = {i: common + f"{i} " * (i * 37 % 900) for i in range(60)} | {60: None, 61: "x", 62: "x", 63: "y" * 3_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain = rows(media.media_columns(docs))
    monkeypatch.setattr(media, "HOT", 10)
    found = media.media_columns(docs, keep_media=True).collect()
    against_texts(found, texts, True)
    assert all(r[c] == plain[r.doc_id][c] for r in found for c in ("media_bytes", "media_sha256", "payload_sha256", "feature"))


# Tiling


def brute_tiles(a, b, least):
    """Greedy string tiling by trying all pairs of positions."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        free_a[i : i + k], free_b[j : j + k] = [False] * k, [False] * k
        out.append(k)


def test_tiles_against_all_positions():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        got = sorted((t[0] for t in tiling.tiles(a, b, 3)), reverse=True)
        want = brute_tiles(a, b, 3)
        assert got == want
        used = [x for k, i, _ in tiling.tiles(a, b, 3) for x in range(i, i + k)]
        assert len(used) == len(set(used))


def test_reordered_passages_are_found(spark):
    item = [f"w{i}" for i in range(40)]
    moved = item[20:] + ["other", "words"] + item[:20]
    docs = spark.createDataFrame([(1, "Start " + " ".join(moved).upper() + "."), (2, "w0 w1 w2 w3 w4 and nothing else"), (3, None), (4, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(item)), (11, None), (12, "a b"), (9, " ".join(item))], "item_id long, text string")
    for bound in (tiling.BOUND, -1):
        got = rows(tiling.contamination(docs, benchmark, bound=bound))
        assert got[1]["contaminated"] and got[1]["item_id"] == 9 and got[1]["coverage"] == 1.0 and got[1]["n_tiles"] == 2 and got[1]["n_items"] == 2
        assert not got[2]["contaminated"] and got[2]["coverage"] == 5 / 40
        assert got[3]["coverage"] == got[4]["coverage"] == 0.0
    none = benchmark.limit(0)
    assert all(r["coverage"] == 0 for r in tiling.contamination(clashing(spark), none).collect())
    assert tiling.contamination(empty(spark), benchmark).count() == 0
    assert [r["doc_id"] for r in tiling.drop_contaminated(docs, benchmark).orderBy("doc_id").collect()] == [2, 3, 4]


def near(doc, item):
    """The document with every word that no common run of five covers made unlike all others, to save the brute force time."""
    seeds = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
    keep = {p + x for p in range(len(doc) - 4) if tuple(doc[p : p + 5]) in seeds for x in range(5)}
    return [w if k in keep else -1 for k, w in enumerate(doc) if k in keep or k - 1 in keep]


def test_both_forms_agree_on_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5"), (1, "nothing"), (None, "w0 w1 w2 w3 w4 w5"), (2, None), (3, "say tiny item now"), (1, "w0 w1 w2 w3 w4 w5"), (4, "Tiny. x item")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "w0 w1 w2 w3 w4 w5"), (9, "zz"), (9, None), (8, "tiny item"), (7, ""), (None, "nothing")], "item_id long, text string")
    want = sorted([(1, 9, 1.0, 1, 1, True), (1, 9, 1.0, 1, 1, True), (1, None, 0.0, 0, 0, False), (2, None, 0.0, 0, 0, False), (3, 8, 1.0, 1, 1, True), (4, None, 0.0, 0, 0, False), (None, 9, 1.0, 1, 1, True)], key=repr)
    for bound in (tiling.BOUND, -1):
        assert sorted(map(tuple, tiling.contamination(docs, items, bound=bound).collect()), key=repr) == want
        assert {tuple(r) for r in tiling.drop_contaminated(docs, items, bound=bound).collect()} == {(1, "nothing"), (2, None), (4, "Tiny. x item")}
        assert tiling.contamination(clashing(spark), items, bound=bound).count() == len(AWKWARD)


def test_decontamination_query(spark, data):
    cache = WordHashes()
    items = {r["item_id"]: cache.of(tiling.words(r["text"])).tolist() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = rows(QUERIES["op4_benchmark_decontamination"](spark, data))
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        doc = cache.of(tiling.words(r["text"])).tolist()
        seeds = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        met = [w for w in items.values() if any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4))]
        want = max((sum(brute_tiles(w, near(doc, w), 5)) / len(w) for w in met), default=0.0)
        assert abs(got[r["doc_id"]]["coverage"] - want) < 1e-12 and got[r["doc_id"]]["contaminated"] == (want >= tiling.COVER)


# BPE


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(PATH)
    return bpe.Codec(tokens, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_equals_the_library(reference):
    codec, own = reference
    rng = random.Random(4)
    chars = [*"abcs't re ll\n\t 0123", "é", "ß", "中", "🙂", "\u0085", "\x1c", "▁", "　", "²", "Ⅷ", "́", "<", "|"]
    texts = ["", " ", "<|endoftext|><unk><s>", LONG[:5000], *("".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000))]
    for t in texts:
        ids = codec.encode(t)
        assert ids == " ".join(map(str, own.encode_ordinary(t))), t
        assert codec.decode(ids) == t.encode()


def test_bpe_rows(spark, reference):
    got = rows(bpe.digests(clashing(spark), PATH, PATTERN))
    for i, t, *_ in AWKWARD:
        ids = reference[1].encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty(spark), PATH, PATTERN).count() == 0
    assert all(r["exact"] for r in bpe.encoded(awkward(spark), PATH, PATTERN, keep=("lang",)).collect())


# Lines


def test_recurring_templates_go(spark):
    a, b = "Served by node 17 at rack 4 of hall B", "Served by node 99 at rack 1 of hall B"
    own = "one two three four five six unlike"
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    edited = passage.replace("pza", "other")
    docs = [(1, f"{a}\nfirst text of its own here now"), (2, f"second text of its own stays too\n{b}"), (3, f"{a}\n{a}\n{own}"), (4, passage + "\n" + own + " x"), (5, edited + "\nshort"), (6, None), (7, ""), (8, "short"), (9, "short"), (10, "short")]
    got = rows(lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[1]["text"] == docs[0][1] and got[2]["text"] == "second text of its own stays too" and got[3]["text"] == own
    assert got[4]["n_dropped"] == 0 and got[5]["text"] == "short"
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "short"
    assert (got[3]["n_lines"], got[3]["n_dropped"]) == (3, 2)


def test_passages_go_wherever_they_stand(spark):
    word = lambda k: "w" + "".join(chr(97 + k // 26**i % 26) for i in range(3))
    run = lambda a, b: " ".join(map(word, range(a, b)))
    broken = "\n".join([run(0, 35), run(35, 43), run(43, 47), "", run(47, 60)])
    docs = [(1, broken), (2, f"own words here\n{run(0, 60).upper()}\nmore"), (3, f"ahead of it {run(0, 60)} and  after it"), (4, run(0, 49)), (5, f"{run(100, 140)} x {run(200, 260)}"), (6, f"{run(100, 140)} {run(200, 260)} y"), (6, None)]
    docs.append((7, "\n".join([run(0, 35), run(35, 43), "other", run(43, 60)])))
    found = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {i: [r for r in found if r["doc_id"] == i] for i in range(1, 8)}
    text = {i: next(r["text"] for r in v if r["text"] is not None) for i, v in got.items()}
    assert text[1] == broken and text[2] == "own words here\nmore" and text[3] == "ahead of it and  after it"
    assert got[2][0]["n_dropped"] == 1 and got[3][0]["n_dropped"] == 0 and got[3][0]["chars_after"] == len(text[3])
    assert text[4] == run(0, 49) and text[5] == docs[4][1] and text[6] == f"{run(100, 140)} y"
    assert text[7] == docs[-1][1]


def test_words_against_plain_python():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", "🙂", " ", "\n", "\t", "9", "@", "://", "\\", "\r", "\u00a0"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "\n", "x"]
    for some in (texts, [None], [""], ["one"]):
        w = lines.Words(some)
        got = [w.raw[a:b].lower() for a, b in zip(w.starts, w.ends, strict=True)]
        want = [(i, x) for i, t in enumerate(some) for x in (t or "").encode().lower().split()]
        assert list(zip(w.text.tolist(), got, strict=True)) == want
        by_hash = {}
        for h, x in zip(w.hashes.tolist(), got, strict=True):
            assert by_hash.setdefault(h, x) == x
        assert len(by_hash) == len(set(got))
        assert ((w.masked() != w.hashes) == [bool(lines.VARIABLE.search(x)) for x in got]).all()
        rows_ = [x for t in some for x in (t or "").encode().split(b"\n")]
        assert [w.raw[a:b] for a, b in zip(w.line_starts, w.line_ends, strict=True)] == rows_ and w.words.tolist() == [len(x.split()) for x in rows_]
        assert len(set(w.line_hashes().tolist())) == len(set(rows_))


def test_equal_passages_have_equal_anchors():
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    shared = words(70)
    texts = [" ".join(words(rng.randrange(45)) + shared + words(rng.randrange(45))) for _ in range(40)] + ["", "a " * 49, "a " * 200]
    w = lines.Words(texts)
    at, keys, low = lines.passages(w.hashes, w.sizes)
    flat = [x for t in texts for x in t.split()]
    runs = {}
    for p, k, a in zip(at.tolist(), keys.tolist(), low.tolist(), strict=True):
        run = tuple(flat[p : p + lines.LONG])
        assert runs.setdefault(run, (k, a)) == (k, a)
    assert len({k for k, _ in runs.values()}) == len(runs)
    assert at.tolist() == [p for p in range(len(flat)) if p + lines.LONG <= len(flat) and w.text[p] == w.text[p + lines.LONG - 1]]
    first, marks = lines.stretches(at, keys, low)
    ends = [*first[1:].tolist(), len(at)]
    same = {}
    for a, b, m in zip(first.tolist(), ends, marks.tolist(), strict=True):
        assert len(set(low[a:b].tolist())) == 1 and at[b - 1] - at[a] == b - 1 - a
        words_ = tuple(flat[at[a] : at[b - 1] + lines.LONG])
        assert same.setdefault(m, words_) == words_


def brute_lines(docs):
    """What is left of each document, from whole templates and passages instead of hashes."""
    token = re.compile(rb"[^ \t\n\r\x0b\x0c]+")

    def templates(words):
        n = len(words)
        fields = [bool(lines.VARIABLE.search(w)) for w in words]
        w = words if 2 * sum(fields) > n else [b"*" if f else x for f, x in zip(fields, words, strict=True)]
        yield (n, -1, tuple(w))
        for i in range(5):
            a, b = n * i // 5, n * (i + 1) // 5
            if a < b and n - (b - a) >= 6:
                yield (n, i, tuple(w[:a]), tuple(w[b:]))

    ids, passage, grams = {}, {}, {}
    for i, t in docs:
        raw = (t or "").encode()
        mine = {}
        for line in raw.split(b"\n"):
            words = line.lower().split()
            if len(words) >= 5:
                for k in templates(words):
                    mine[k] = len(words) >= 50
        for k, long in mine.items():
            ids.setdefault(k, set()).add(i)
            passage[k] = passage.get(k, False) or long
        words = raw.lower().split()
        for p in range(len(words) - 49):
            grams.setdefault(tuple(words[p : p + 50]), set()).add(i)
    often = {k: min(v) for k, v in ids.items() if len(v) >= (2 if passage[k] else 3)}
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        spans = [m.span() for m in token.finditer(raw)]
        words = [raw[a:b].lower() for a, b in spans]
        lost = set()
        for p in range(len(words) - 49):
            held = grams[tuple(words[p : p + 50])]
            if len(held) > 1 and i != min(held):
                lost |= set(range(p, p + 50))
        kept, at, k = [], 0, 0
        for line in raw.split(b"\n"):
            mine = [j for j in range(len(spans)) if at <= spans[j][0] < at + len(line)] if lost else []
            w = line.lower().split()
            if not ((len(w) >= 5 and any(often.get(x, i) != i for x in templates(w))) or (mine and all(j in lost for j in mine))):
                if any(j in lost for j in mine):
                    left = b""
                    for j in mine:
                        if j not in lost:
                            left += (raw[spans[j - 1][1] : spans[j][0]] if j - 1 in mine and j - 1 not in lost else b" " if left else b"") + raw[slice(*spans[j])]
                    kept.append(left)
                else:
                    kept.append(line)
            at += len(line) + 1
        out.append((i, None if t is None else b"\n".join(kept).decode()))
    return out


def test_dropped_lines_against_brute_force(spark, data):
    rng = random.Random(6)
    made = [f"{rng.choice(['Welcome', 'Hello', 'Bye'])} user {rng.choice('abcdefgh') * 3} to the {rng.choice(['member', 'guest'])} area of day {rng.randrange(9)}" for _ in range(60)]
    rest = [" ".join(rng.choice(["one", "two", "3", "four", "5", "x6"]) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    docs = [(rng.randrange(40), "\n".join(rng.choice([*made, *rest]) for _ in range(rng.randrange(1, 6)))) for _ in range(80)]
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(brute_lines(docs), key=repr)


def test_names_generalise_and_repeated_ids_keep_their_text(spark):
    docs = [(i, f"Welcome user {n} to the member area today") for i, n in enumerate(("alice", "bob", "carol", "dave", "erin"))]
    docs += [(10, "keep this one\nunique second line stays put now\nthird"), (10, "x\nserved by the same node as all others\ny"), (9, "served by the same node as all others"), (12, "served by the same node as all others")]
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, docs[0][1]), (1, ""), (2, ""), (3, ""), (4, ""), (9, docs[-2][1]), (10, docs[5][1]), (10, "x\ny"), (12, "")]


def test_line_rows(spark):
    out = lines.dedup_lines(clashing(spark))
    assert out.count() == len(AWKWARD) and set(clashing(spark).columns) - {*lines.COUNTS} <= set(out.columns)
    assert {r["n_lines_"] for r in out.collect()} == {"v"} and out.columns.count("n_lines") == 1
    assert lines.dedup_lines(empty(spark)).count() == 0


# Preferences


def test_preferences_against_sql(spark, data):
    con = oracle.connect(data)
    assert oracle.compare(QUERIES["op9_preference_formatting"](spark, data), con, ORACLE_SQL["op9_preference_formatting"]) == ""


def test_preferences_of_the_table(spark, data):
    got = QUERIES["op9_preference_formatting"](spark, data.replace("sf0.001", "sf0.01")).collect()  # of all lengths
    assert got and all(r["rejected_id"] is not None and r["chosen"] and r["chosen"] != r["rejected"] for r in got)
    parted = Counter(r["prefix_turns"] for r in got)
    assert len(parted) > 3 and max(parted.values()) < 0.8 * len(got) and all(r["prompt"] for r in got if r["prefix_turns"])


def test_preferences_of_siblings(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (3, 0, "user", "q"), (3, 1, "assistant", "a1"), (3, 2, "user", "more"), (3, 3, "assistant", "a3"), (4, 0, "user", None), (4, None, None, "x"), (None, 0, "user", "q"), (5, 0, "user", "alone"), (6, 0, "user", "q"), (6, 1, "assistant", "a1")]
    turns += [(100 + i, k, role, f"{role} {i % 37} {k}") for i in range(300) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"][: 3 + i % 3])]
    turns += [(1000 + i, k, role, "hot" if k == 0 else f"{i} {k}") for i in range(200) for k, role in enumerate(["user", "assistant"])]
    df = spark.createDataFrame([(*t, "v") for t in turns], "conv_id long, turn long, role string, text string, key string")
    out = preferences.preference_pairs(df)
    got = {(r["kind"], r["chosen_id"], r["rejected_id"]): r for r in out.collect()}
    assert len(got) == out.count()
    pairs = {(c, r) for kind, c, r in got if kind == "sibling"}
    # 1 and 6 are one conversation; all of an opening are joined; the longer one is chosen.
    small = {p for p in pairs if max(p) < 100}
    assert len(small) == 2 and all(c == 3 or r != 3 for c, r in small) and {x for p in small for x in p} == {1, 2, 3}
    hot = [p for p in pairs if min(p) >= 1000]
    seen, todo = set(), [1000]
    while todo:
        x = todo.pop()
        seen.add(x)
        todo += [y for p in hot if x in p for y in p if y not in seen]
    assert len(seen) == 200 and len(hot) == 199
    own = next(r for (kind, c, _), r in got.items() if kind == "stand-in" and c == 1)
    assert own["n_copies"] == 2 and own["prefix_turns"] == 1 and own["prompt"] == "<|user|>\nq\n" and own["chosen"] == "<|assistant|>\na1\n" and own["chosen_mask"] == "11:0,14:0,2:1,1:0"
    assert own["rejected"].startswith("<|assistant|>\n") and own["rejected"] != own["chosen"]
    assert not any(c in (4, 5) or r in (4, 5) for _, c, r in got)
    df.drop("key").coalesce(1).write.parquet(str(tmp_path / "c"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert oracle.compare(out, con, ORACLE_SQL["op9_preference_formatting"]) == ""
    assert preferences.preference_pairs(df.limit(0)).count() == 0
