"""Text operators against plain Python on small tables: nulls, ties, repeats, long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from tracefold.llm import bpe, decontaminate, line_dedup, orc_tokens, repeats, stages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " ", "\n\n", "x", "Ünï © 日本\n\n z", "a\x00b\n" * 3]


def docs_of(spark, texts, ids=None, **extra):
    """Documents with columns whose names clash with those the operators use."""
    rows = [(i, t, "tag", 7, "hits") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tag string, id long, hits string")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rng_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [rng_text(rng, words, 14) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else rng_text(rng, words, rng.randint(0, 25))
                 for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    return out


def lines_expected(rows, min_docs=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 40:
                holders.setdefault(key, set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_line_dedup(spark, partitions):
    texts = random_texts(1, 60) + ODD + ["  " + "Long line " * 5 + "\t\nother\n" + "long LINE " * 5] * 9
    ids = [i // 2 if i % 7 == 0 else i for i in range(len(texts))]  # some ids occur twice
    rows = list(zip(ids, texts))
    docs = docs_of(spark, texts, ids).repartition(partitions)
    got = sorted(tuple(r) for r in line_dedup.line_digests(docs).collect())
    assert got == lines_expected(rows)


def test_line_dedup_hot_key_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        texts = ["shared line that is long enough to be compared\nown %d" % i for i in range(400)]
        docs = docs_of(spark, texts)
        got = sorted(tuple(r) for r in line_dedup.line_digests(docs).collect())
        assert got == lines_expected(list(enumerate(texts)))
        assert sum(r[2] for r in got) == 399
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_empty_table_and_null_id(spark):
    assert line_dedup.line_digests(docs_of(spark, ["x"]).limit(0)).collect() == []
    text = "a line that is certainly longer than forty characters"
    got = line_dedup.line_dedup(docs_of(spark, [text] * 6, [None, 1, 2, 3, 4, 5])).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]


def contamination_expected(docs, items):
    windows = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                got = windows.get(tuple(w[s:s + size]))
                if got:
                    found |= got
                    hit |= set(range(s, s + size))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


def test_contamination(spark):
    texts = random_texts(2, 80) + ODD
    items = list(enumerate(random_texts(2, 30)[10:25] + ["zz qq", "a", "", None, "Abc1 zz qq"] + random_texts(3, 5)))
    texts += ["say ABC1 zz, qq now", "a " * 30, items[0][1], items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs_of(spark, texts), bench).collect())
    assert got == contamination_expected(list(enumerate(texts)), items)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, ["a b c"]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, ["x"]).limit(0), some).count() == 0


def test_contamination_counts_items_without_id(spark):
    named, unnamed, short = (" ".join(f"{w}{i}" for i in range(25)) for w in ("named", "null", "short"))
    texts = [unnamed, named + " q " + unnamed, named, short + " zz qq", "nothing of it"]
    items = [(None, unnamed), (7, named), (None, "zz qq"), (8, "zz qq")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    hits = {e[0]: e for e in contamination_expected(list(enumerate(texts)), items)}
    lists = {0: (1, ""), 1: (2, "7"), 2: (1, "7"), 3: (2, "8"), 4: (0, "")}
    for i, (n, ids) in lists.items():
        assert (got[i].n_hit, got[i].contaminated) == (hits[i][2], hits[i][5])
        assert (got[i].n_items, got[i].items_sha256) == (n, sha(ids))
    assert [r.doc_id for r in stages.uncontaminated(docs, bench).collect()] == [4]


def test_winnowing_finds_every_long_span():
    rng = np.random.default_rng(4)
    span = rng.integers(1, 1 << 62, 10).astype(np.uint64)
    prints = set()
    for _ in range(50):
        around = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        at = rng.integers(0, 30)
        around[at:at + 10] = span
        prints.add(int(decontaminate.winnow(around, 10, 5)[at]))
    assert len(prints) == 1


def repeats_expected(rows):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_strings(spark, seed):
    rng = random.Random(seed)
    texts = random_texts(seed, 60) + ODD + ["ab" * 400, "ab" * 40 + "x", "é" * 60, "q" * 49, "q" * 50, "q" * 51]
    texts += [t[:30] + "!" + t[31:] for t in texts[:10] if t] + texts[:5]
    ids = [rng.randint(0, 60) for _ in texts]
    got = sorted(tuple(r) for r in repeats.without_repeats(docs_of(spark, texts, ids).repartition(5), digest=True).collect())
    assert got == repeats_expected(list(zip(ids, texts)))


def test_repeated_strings_long_text_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PASS", 300)
    texts = random_texts(8, 12)
    texts = [" ".join(texts[:6]) * 3, " ".join(texts[4:9]), texts[0], texts[5] + texts[1]]
    column = pa.array([t.encode() for t in texts], pa.binary())
    small = [x.tolist() for x in repeats.parse(column)]
    monkeypatch.setattr(repeats, "PASS", 1 << 20)
    whole = [x.tolist() for x in repeats.parse(column)]
    assert sorted(set(zip(*small))) == sorted(set(zip(*whole)))


def test_repeated_strings_empty(spark):
    assert repeats.without_repeats(docs_of(spark, ["x"]).limit(0), digest=True).collect() == []


TRICKY = ["it's we'll 's x's 'sx ''s !'s don't I'LL o'clock'd", "a  b \n\n c\t\td  ", "İstanbul ΣΑΣ é ﬁ ½ 12345 日本 👍🏽 　z\n",
          "<|endoftext|>abc<|startoftext|> <|endoftext|>", "x" * 700, "ab" * 900 + " q", "'" * 7 + "s", " 's", "\n's 're",
          "1 22 333\n 4", "  '  's", "ǅ ẞ ŉ don’t"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return lambda name: Tokenizer.from_file(public_tokenizers.path(name))


def test_token_codec(spark, library):
    texts = random_texts(9, 20) + ODD + TRICKY
    tokenizer = library("word_bpe_49k.json")
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()),
                     sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.token_digests(docs_of(spark, texts)).collect()) == want
    assert bpe.token_digests(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_transducer_streams_with_bounded_memory():
    import public_tokenizers
    machine, encoder, decoder = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    word = ("thestreamgoeson" * 300).encode()
    blocks = [word[i:i + 7] for i in range(0, len(word), 7)]
    ids = list(machine.stream(blocks))
    assert ids == machine.encode(word)
    most = 0
    real = machine.stable

    def watched(last, base, n):
        nonlocal most
        most = max(most, n - base)
        return real(last, base, n)
    machine.stable = watched
    list(machine.stream(blocks))
    assert 0 < most < 20 * machine.lookahead


def test_byte_decoder_waits_for_whole_characters():
    names = {i: c for i, c in enumerate(bpe.byte_chars())}
    decoder = bpe.Decoder(names, {"type": "ByteLevel"})
    text = "né 日本 👍"
    ids = np.array(list(text.encode()))
    assert "".join(decoder.stream([ids[i:i + 1] for i in range(len(ids))])) == text


def test_orc_tokens(spark, library):
    texts = random_texts(10, 40) + ODD + TRICKY
    ids = [(i * 37) % 1000 for i in range(len(texts))]
    tokenizer = library("byte_bpe_50k.json")
    want, start = [], 0
    for i, t in sorted(zip(ids, texts)):
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in orc_tokens.token_rows(docs_of(spark, texts, ids)).collect()) == want
    assert orc_tokens.token_rows(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_orc_files_hold_bloom_filters(spark, tmp_path):
    import pyarrow.orc as orc
    orc_tokens.write_tokens(docs_of(spark, random_texts(11, 50)), str(tmp_path / "t"))
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert files and sum(orc.ORCFile(str(f)).nrows for f in files) == 50
    row = orc_tokens.read_tokens(spark, str(tmp_path / "t")).where(F.col("doc_id") == 7).collect()
    assert len(row) == 1 and isinstance(row[0], Row)
