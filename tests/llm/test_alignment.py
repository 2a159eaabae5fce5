"""Token alignment against a direct computation, with chunks so small that texts span many."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tracefold.llm import align
from tracefold.llm.align import compose

ODD = [None, "", " ", "\n\n", "x", "  lead and trail  ", "Ünï © 日本\n\n z", "a\x00b\n" * 3, "it's we'll <|endoftext|> <s>",
       "piece▁mark", "\U0001F600 é é\t\r\n", "日本語" * 40, "<0x0A> \xa0x　y"]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日'1.") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)] + ["word " * 400] * 2


def tokens_of(text):
    tool = align.aligner(align.token_path(align.BYTE_LEVEL), align.token_path(align.PIECES))
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(align.token_path(align.BYTE_LEVEL))
    library.encode_special_tokens = True
    if not text:
        return [], []
    out = []
    for ids, vocabulary in ((library.encode(" " + text, add_special_tokens=False).ids, tool.a),
                            (tool.piece.encode(text), tool.b)):
        end, found = 0, []
        for i in ids:
            end += int(vocabulary.sizes[i])
            found.append((i, end))
        raw = b"".join(vocabulary.flat[vocabulary.starts[i]:vocabulary.starts[i] + vocabulary.sizes[i]].tobytes()
                       for i in ids)
        if raw != (" " + text).encode():
            return [], []
        out.append(found)
    return out


def expected(rows):
    docs, count = [], Counter()
    for i, text in rows:
        a, b = tokens_of(text)
        ends = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append(([t for t, x in a if low < x <= e], [t for t, x in b if low < x <= e]))
            low = e
        links = [(t, u) for t, x in a for u, y in b if x == y]
        count.update(links)
        docs.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, u), n in count.items():
        most[u] = max(most[u], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("chunk,partitions", [(align.CHUNK, 3), (64, 5)])
def test_digests_equal_a_direct_computation(spark, chunk, partitions):
    rows = [(None if i == 5 else i // 2 if i % 9 == 0 else i, t) for i, t in enumerate(texts(3, 40))]
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows],
                                 "doc_id long, text string, row int, block string, chunk int").repartition(partitions)
    got = [tuple(r) for r in align.alignment_digests(docs, chunk=chunk).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_groups_are_the_same_in_any_chunks(spark):
    docs = spark.createDataFrame(list(enumerate(texts(4, 10))), "doc_id long, text string").repartition(2)
    found = []
    for chunk in (48, 1000, align.CHUNK):
        pieces = sorted((r.doc_id, r.chunk, r.part, r.groups)
                        for r in align.aligned_groups(docs, chunk=chunk).collect())
        whole = defaultdict(list)
        for i, _, _, text in pieces:
            whole[i].append(text)
        found.append({i: ";".join(t) for i, t in whole.items()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 15


def test_empty_table_and_pair_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment_digests(none).collect() == []
    docs = spark.createDataFrame([(1, "a b a"), (2, "a")], "doc_id long, text string")
    assert sorted(r.n for r in align.alignment_table(docs).collect()) == [1, 3]


def test_composition_is_associative():
    rng = random.Random(1)

    def node(i):
        one = lambda: [rng.randrange(9) for _ in range(rng.randint(0, 2))]
        return {"first": rng.choice([None, i]), "pre_a": one(), "pre_b": one(), "suf_a": [], "suf_b": []}

    def fold(parts):
        whole, closed = parts[0], []
        for part in parts[1:]:
            whole, group = compose(whole, part)
            closed += [group] if group else []
        return whole, closed

    for _ in range(200):
        parts = [node(i) for i in range(6)]
        k = rng.randint(1, 5)
        (left, a), (right, b) = fold(parts[:k]), fold(parts[k:])
        whole, group = compose(left, right)
        assert (whole, sorted(a + b + ([group] if group else []))) == (lambda w, c: (w, sorted(c)))(*fold(parts))


def test_texts_are_tokenised_in_passes_of_bounded_size(monkeypatch):
    tool = align.Aligner(align.token_path(align.BYTE_LEVEL), align.token_path(align.PIECES))
    raws = [f" {'ab c' * (i % 7)} word{i} é{i}\u0000"[:i % 40 + 1].encode() for i in range(400)] + [b"", b" x" * 900]
    want = tool.aligned_pass(raws)
    seen, one = [], tool.aligned_pass
    monkeypatch.setattr(align, "PASS", 1000)
    monkeypatch.setattr(tool, "aligned_pass", lambda some: seen.append(some) or one(some))
    tool.encoder.kept = 50
    got = tool.aligned(raws)
    assert all(sum(map(len, some)) <= 1000 or len(some) == 1 for some in seen) and len(seen) > 5
    assert len(tool.encoder.slot) < 400
    for a, b in zip((got[0], *got[1], *got[2]), (want[0], *want[1], *want[2])):
        assert a.tolist() == b.tolist()
