"""Periodic runs and license scans against direct computations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracefold.llm import license_scan, periodic_runs
from tracefold.llm.periodic_runs import LEAST, runs_of
from tracefold.llm.textcore import mix

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHAPE = "doc_id long, text string, row int, words string, runs int, n int"


def docs_of(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3) for i, t in rows], SHAPE).repartition(partitions)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((v is None, v) for v in row)


def runs_brute(words, least=LEAST):
    """Every lag over the whole text; a stretch counts once, with its smallest lag."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def run_row(i, text):
    words = BLANKS.findall(text or "")
    n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    runs = runs_brute(words)
    gone = {j for s, length, q in runs for j in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))


def random_words(rng):
    k = rng.choice([1, 2, 2, 3, 4, 8, 40])
    out = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        if part and rng.random() < 0.5:
            part = (part * rng.randint(2, 6))[:-rng.randint(1, len(part))]
        out += part
    return out


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits


def test_runs_of_random_and_hard_sequences():
    rng = random.Random(5)
    for t in range(120):
        rows = [random_words(rng) for _ in range(rng.randint(1, 8))]
        if t % 40 == 0:
            rows += [([0] * 100 + [1]) * 3, thue_morse(256) * 2, list(range(300)) * 2]
        flat = np.array([w for r in rows for w in r], dtype=np.uint64)
        bounds = np.append(0, np.cumsum([len(r) for r in rows]))
        got = list(zip(*(x.tolist() for x in runs_of(mix(flat + np.uint64(7)), bounds))))
        assert got == [(i, *r) for i, words in enumerate(rows) for r in runs_brute(words)]


def test_one_word_over_and_over_is_quick():
    (row,), (start,), (length,), (period,) = runs_of(mix(np.full(200_000, 3, np.uint64)), np.array([0, 200_000]))
    assert (row, start, length, period) == (0, 0, 200_000, 1)


@pytest.mark.parametrize("partitions", [1, 6])
def test_run_digests(spark, partitions):
    rng = random.Random(8)
    rows = [(i, " \n".join("wé%d" % w for w in random_words(rng))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (None, "a b " * 9), (3, "x " * 30), (3, "x " * 30), (73, "a b " * 20)]
    docs = periodic_runs.planted(docs_of(spark, rows, partitions))
    got = [tuple(r) for r in periodic_runs.run_digests(docs).collect()]
    assert sorted(got, key=key) == sorted((run_row(*r) for r in rows), key=key)


def test_periodic_runs_gives_texts(spark):
    text = "start " + "la di da " * 5 + "end"
    row = periodic_runs.periodic_runs(docs_of(spark, [(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "start la di da end"
    assert periodic_runs.periodic_runs(docs_of(spark, []).limit(0)).collect() == []


def base_row(i, text):
    words = WORD.findall((text or "").translate(LOWER))
    places = sorted((j, label) for phrase, label in license_scan.BASE.items()
                    for j in range(len(words)) if words[j:j + len(phrase.split())] == phrase.split())
    return (i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))


LICENSED = [
    "Released under the MIT License.", "gnu GNU General Public License gnu general PUBLIC", "cc by CC-BY cc by cc",
    "MIT\nLicense apache license, Apache-License mit licensee", "Licensed under CC BY-NC 4.0.", "gnu general license"]
BODY = next(t for t, label in license_scan.TEXTS.items() if label == "bsd")


def test_base_places(spark):
    rows = list(enumerate(LICENSED)) + [(20, None), (21, ""), (22, "mit"), (None, "cc by"), (4, LICENSED[4]), (4, LICENSED[4]),
                                        (23, "word " * 30000 + "cc by " * 500)]
    got = license_scan.license_scan(docs_of(spark, rows))
    found = [tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(found, key=key) == sorted((base_row(*r) for r in rows), key=key)
    assert license_scan.license_scan(docs_of(spark, []).limit(0)).collect() == []


def test_texts_with_changes_hold_and_fragments_do_not(spark):
    words = BODY.split()
    changed = " ".join(words[:8] + ["really"] + words[8:14] + words[15:])
    rows = [(1, "intro " * 9 + BODY), (2, changed), (3, " ".join(words[:6])), (4, " x ".join(words)),
            (5, " ".join(reversed(words))), (6, "mit license " + BODY)]
    got = {r.doc_id: r for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["bsd", "bsd", "", "", "", "bsd,mit"]
    assert got[1].score == 1.0 and 0.8 <= got[2].score < 1 and 0 < got[3].score < 0.8 and got[5].score == 0
    spans = {r.row: r for r in license_scan.spans(docs_of(spark, rows[:1], 1)).collect() if r.holds}
    assert [(r.start, r.stop) for r in spans.values()] == [(9, 9 + len(words))]


def test_no_python_in_the_plan(spark):
    plan = license_scan.license_scan(docs_of(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
