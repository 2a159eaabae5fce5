"""Alignment of the tokens of two tokenizers by a monoid of fragments.

A byte range of a text gives a fragment: an open prefix (tokens up to the first byte at which
tokens of both tokenizers end), closed groups (between such bytes) and an open suffix.  Two
neighbouring fragments compose: the suffix of the left one and the prefix of the right one
become a closed group, or stay open when one side has no common end.  Composition is
associative, so the fragments of a very long text, made by different tasks, are reduced as a
tree of bounded nodes; a text of up to :data:`CHUNK` bytes is one fragment without open ends.

A chunk is tokenised from the last certain cut before it to the first one behind it (a blank
between ASCII letters, where neither tokenizer joins) and owns the tokens that end inside it.

Pair counts follow the same economy.  Every block of about a megabyte of text sends its
distinct id pairs with their numbers, so a frequent pair is one row per block; the totals come
back to the block, which applies them to the links it keeps as places in its own list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.bpe import byte_chars, token_path
from tracefold.llm.common import cut
from tracefold.llm.pretokens import Encoder
from tracefold.llm.textcore import column_bytes, pieces, slices

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of a chunk of a long text, and of the texts of one block.
CHUNK = 1 << 16
BLOCK = 1 << 20
#: Bytes tokenised in one pass, and pre-tokens kept per worker: a worker holds little beside the two tokenizers.
PASS = 1 << 18
KEPT = 200_000
#: Fragments composed by one node of the tree.
FAN = 16

FRAGMENT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()),
    ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups", pa.string()), ("pre_a", pa.list_(pa.int32())), ("pre_b", pa.list_(pa.int32())),
    ("suf_a", pa.list_(pa.int32())), ("suf_b", pa.list_(pa.int32())),
    ("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())),
    ("raw", pa.binary()), ("own", pa.list_(pa.int64()))])
FRAGMENT_DDL = (
    "row long, doc_id long, chunk int, chunks int, ok boolean, n_a long, n_b long, n_groups long, "
    "groups string, pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>, "
    "block long, pairs array<long>, counts array<long>, rows array<long>, sizes array<int>, "
    "links array<int>, raw binary, own array<long>")


class Vocabulary:
    """Bytes of every token of a tokenizer."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return slices(self.flat, self.starts[ids], self.sizes[ids])


class Aligner:
    """Both tokenizers, and the decimal digits of their ids."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path_a)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        self.encoder = Encoder(
            lambda found: [e.ids for e in library.encode_batch_fast(found, add_special_tokens=False)], spaced=True,
            kept=KEPT)
        back = {c: b for b, c in enumerate(byte_chars())}
        names = {i: s for s, i in library.get_vocab(with_added_tokens=False).items()}
        self.a = Vocabulary([bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1)])
        self.piece = SentencePieceProcessor(model_file=path_b)
        count = self.piece.get_piece_size()
        found = [self.piece.id_to_piece(i) for i in range(count)]
        if any("▁" in p.lstrip("▁") for p in found):
            raise ValueError("a piece goes on behind a blank: texts have no certain cuts")
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.piece.is_byte(i)
                             else p.replace("▁", " ").encode() for i, p in enumerate(found)])
        self.digits = Vocabulary([b"%d," % i for i in range(max(len(self.a.sizes), count))])

    def tokens(self, raws: list[bytes]):
        """Ids and their number per text of both tokenizers; every text begins with a blank."""
        parts = list(self.encoder.encode(pa.array(raws, pa.binary())))
        ids = np.concatenate([p[2] for p in parts]).astype(np.int64)
        counts = np.concatenate([p[3] for p in parts])
        found = self.piece.encode([r[1:].decode("utf-8", "replace") for r in raws], num_threads=1)
        sizes = np.array([len(f) for f in found], np.int64)
        return ids, counts, np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum())), sizes

    def aligned(self, raws: list[bytes]):
        """(ok, A, B): per side ids, row, end byte (over all texts) and whether both end there.

        Texts whose tokens do not give back their bytes are not ok and have no tokens.
        """
        oks, parts, base = [], ([], []), 0
        for low, high in pieces(np.append(0, np.cumsum([len(r) for r in raws])), PASS):
            ok, *sides = self.aligned_pass(raws[low:high])
            for side, (ids, row, end, common) in zip(parts, sides):
                side.append((ids, row + low, end + base, common))
            oks.append(ok)
            base += sum(len(r) for r, good in zip(raws[low:high], ok.tolist()) if good)
        return np.concatenate(oks), *([np.concatenate(x) for x in zip(*side)] for side in parts)

    def aligned_pass(self, raws: list[bytes]):
        """:meth:`aligned` of texts that are looked at together."""
        ids_a, n_a, ids_b, n_b = self.tokens(raws)
        length = np.array([len(r) for r in raws], np.int64)
        same = []
        for vocabulary, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            made = vocabulary.bytes_of(ids)
            ends = np.append(0, np.cumsum(vocabulary.sizes[ids]))[np.append(0, np.cumsum(n))]
            blob = made.tobytes()
            same.append(np.array([blob[i:j] == r for i, j, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raws)]))
        ok = same[0] & same[1] & (length > 0)
        length[~ok] = 0
        out = []
        for vocabulary, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            row = np.repeat(np.arange(len(raws)), n)
            ids, row = ids[ok[row]], row[ok[row]]
            out.append([ids, row, np.cumsum(vocabulary.sizes[ids])])
        for side, other in ((0, 1), (1, 0)):
            mark = np.zeros(int(length.sum()) + 1, dtype=bool)
            mark[out[other][2]] = True
            out[side].append(mark[out[side][2]])
        return ok, out[0], out[1]

    def text(self, ids_a, last_a, ids_b, last_b) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;`` of every group one after the other, and where each group ends."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[group_a]
        at_b = np.arange(len(ids_b)) + np.cumsum(count_a)[group_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        out = self.digits.bytes_of(ids).copy()
        ends = np.cumsum(self.digits.sizes[ids])
        out[ends[at_a[last_a]] - 1] = ord("|")
        out[ends[at_b[last_b]] - 1] = ord(";")
        return out, ends[at_b[last_b]]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def one_of(values, n: int, kind) -> pa.Array:
    """A list column that holds ``values`` in its first row and null in the others."""
    offsets = pa.array([0, *[None] * (n - 1), len(values)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns.get(f.name, pa.nulls(n, f.type)) for f in FRAGMENT], schema=FRAGMENT)


def linked(block: int, rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    """Columns that describe the links of a block, in its first row."""
    pairs, places, counts = np.unique(codes, return_inverse=True, return_counts=True)
    n = len(rows)
    return {"block": pa.array(np.full(n, block), pa.int64()), "pairs": one_of(pairs, n, pa.int64()),
            "counts": one_of(counts, n, pa.int64()), "rows": one_of(rows, n, pa.int64()),
            "sizes": one_of(sizes, n, pa.int32()), "links": one_of(places.ravel(), n, pa.int32())}


def whole_texts(tool: Aligner, block: int, rows: np.ndarray, ids: pa.Array, raws: list[bytes],
                digest: bool) -> pa.RecordBatch:
    """Fragments of texts that are one chunk each: groups only, nothing open."""
    n = len(raws)
    ok, a, b = tool.aligned(raws)
    text, ends = tool.text(a[0], a[3], b[0], b[3])
    groups = np.bincount(b[1][b[3]], minlength=n)
    stops = np.append(0, ends)[np.cumsum(groups)]
    blob = text.tobytes()
    texts = [blob[i:j - 1] for i, j in zip(np.append(0, stops)[:-1].tolist(), stops.tolist())]
    shown = [None if not good else hashlib.sha256(t).hexdigest() if digest else t.decode()
             for good, t in zip(ok.tolist(), texts)]
    codes = (b[0][b[3]] << 32) | a[0][a[3]]
    return batch(n, row=pa.array(rows), doc_id=ids, chunk=pa.array(np.zeros(n), pa.int32()),
                 chunks=pa.array(np.ones(n), pa.int32()), ok=pa.array(ok),
                 n_a=pa.array(np.bincount(a[1], minlength=n), pa.int64()),
                 n_b=pa.array(np.bincount(b[1], minlength=n), pa.int64()),
                 n_groups=pa.array(groups, pa.int64()), groups=pa.array(shown, pa.string()),
                 **linked(block, rows, codes, groups))


def one_chunk(tool: Aligner, block: int, row: int, doc_id, chunk: int, chunks: int, raw: bytes,
              own: list[int]) -> pa.RecordBatch:
    """Fragment of the byte range ``own`` of a stretch of a long text."""
    ok, *sides = tool.aligned([raw])
    mine = []
    for ids, _, end, common in sides:
        inside = (end > own[0]) & (end <= own[1])
        mine.append((ids[inside], end[inside], common[inside]))
    (a, end_a, both_a), (b, end_b, both_b) = mine
    n = int(both_a.sum())
    first, last = (int(end_a[both_a][0]), int(end_a[both_a][-1])) if n else (own[1], own[1])
    cut_a, cut_b = (end_a > first) & (end_a <= last), (end_b > first) & (end_b <= last)
    closed = tool.text(a[cut_a], both_a[cut_a], b[cut_b], both_b[cut_b])[0].tobytes()[:-1].decode()
    open_ = {name: pa.array([values.tolist()], pa.list_(pa.int32())) for name, values in (
        ("pre_a", a[end_a <= first]), ("pre_b", b[end_b <= first]),
        ("suf_a", a[end_a > last]), ("suf_b", b[end_b > last]))}
    return batch(1, row=pa.array([row]), doc_id=pa.array([doc_id], pa.int64()), chunk=pa.array([chunk], pa.int32()),
                 chunks=pa.array([chunks], pa.int32()), ok=pa.array(ok), n_a=pa.array([len(a)]),
                 n_b=pa.array([len(b)]), n_groups=pa.array([n]), groups=pa.array([closed or None], pa.string()),
                 **open_, **linked(block, np.array([row]), (b[both_b] << 32) | a[both_a], np.array([n])))


def chunk_rows(row: int, doc_id, text: bytes, size: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of a long text, each inside a stretch between certain cuts."""
    data = np.frombuffer(text, np.uint8)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    cuts = np.flatnonzero((data[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
    cuts = np.concatenate([[0], cuts, [len(data)]])
    total = -(-len(data) // size)
    for chunk in range(total):
        low, high = chunk * size, min((chunk + 1) * size, len(data))
        start = int(cuts[np.searchsorted(cuts, low, "right") - 1])
        stop = int(cuts[np.searchsorted(cuts, high)])
        yield batch(1, row=pa.array([row]), doc_id=pa.array([doc_id], pa.int64()),
                    chunk=pa.array([chunk], pa.int32()), chunks=pa.array([total], pa.int32()),
                    raw=pa.array([text[start:stop]], pa.binary()),
                    own=pa.array([[low - start, high - start]], pa.list_(pa.int64())))


def fragments(docs: DataFrame, paths: tuple[str, str] | None = None, chunk: int = CHUNK,
              digest: bool = False) -> DataFrame:
    """Fragments of every text (see :data:`FRAGMENT`), written as a table.

    Texts of one chunk hold all their ``groups`` (or their digest); null and empty texts and
    those that a tokenizer does not give back byte by byte are not ``ok``.
    """
    file_a, file_b = paths or (token_path(BYTE_LEVEL), token_path(PIECES))

    def first(batches):
        tool, part, block = aligner(file_a, file_b), TaskContext.get().partitionId(), 0
        for source in batches:
            _, offsets = column_bytes(source.column("text"))
            for low, high in pieces(offsets, BLOCK):
                piece = source.slice(low, high - low)
                texts = piece.column("text").to_pylist()
                long = np.array([len(t) > chunk for t in texts])
                for i in np.flatnonzero(long).tolist():
                    yield from chunk_rows(piece.column("row")[i].as_py(), piece.column("doc_id")[i].as_py(),
                                          texts[i], chunk)
                rest = np.flatnonzero(~long)
                if len(rest):
                    some = piece.take(pa.array(rest))
                    yield whole_texts(tool, (part << 32) + block, some.column("row").to_numpy(),
                                      some.column("doc_id"), [texts[i] for i in rest.tolist()], digest)
                    block += 1

    def second(batches):
        tool, part, block = aligner(file_a, file_b), TaskContext.get().partitionId(), 0
        for source in batches:
            for i in range(source.num_rows):
                block += 1  # below zero: apart from the blocks of whole texts
                yield one_chunk(tool, -((part << 32) + block), *(
                    source.column(c)[i].as_py() for c in ("row", "doc_id", "chunk", "chunks", "raw", "own")))

    text = F.concat(F.lit(" "), F.col("text"))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.when(F.length("text") > 0, F.encode(text, "UTF-8")).otherwise(F.lit(b"")).alias("text"))
    found = cut(source.mapInArrow(first, FRAGMENT_DDL))
    stretches = found.where(F.col("raw").isNotNull()).repartition("row", "chunk")
    long = cut(stretches.mapInArrow(second, FRAGMENT_DDL))
    found = found.where(F.col("raw").isNull()).unionByName(long).drop("raw", "own")
    bad = long.where(~F.col("ok")).select("row").distinct()
    return found.where(F.col("chunks") == 1).unionByName(
        found.where(F.col("chunks") > 1).join(bad.withColumn("bad", F.lit(True)), "row", "left")
        .withColumn("ok", F.col("bad").isNull()).drop("bad"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair ``b << 32 | a``; ``best`` within its B id, ties included."""
    counts = cut(found.where(F.col("pairs").isNotNull() & (F.col("ok") | (F.col("chunks") == 1)))
                 .select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
                 .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")))
    token = F.shiftright("pair", 32).cast("int")
    most = counts.groupBy(token.alias("b")).agg(F.max("n").alias("most"))  # at most the vocabulary
    return counts.withColumn("b", token).join(F.broadcast(most), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_table(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, n, best): how often tokens of both tokenizers end together in the corpus."""
    return pair_counts(fragments(docs, paths)).select(
        F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("a"),
        F.shiftright("pair", 32).cast("int").alias("b"), "n", "best")


def link_sums(found: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): the counts applied to the links of every text."""
    counts = cut(pair_counts(found))
    blocks = found.where(F.col("pairs").isNotNull() & (F.col("ok") | (F.col("chunks") == 1))).where(
        F.size("links") > 0)
    replies = (blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
               .groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("known")))

    def apply(batches):
        for source in batches:
            for i in range(source.num_rows):
                known = source.column("known")[i].values
                place = known.field("place").to_numpy()
                n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                n[place] = known.field("n").to_numpy()
                best[place] = known.field("best").to_numpy(zero_copy_only=False)
                links = source.column("links")[i].values.to_numpy()
                size = source.column("sizes")[i].values.to_numpy()
                ends = np.append(0, np.cumsum(size))
                sums = [np.diff(np.append(0, np.cumsum(x[links]))[ends]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays(
                    [source.column("rows")[i].values, *(pa.array(s, pa.int64()) for s in sums)],
                    names=["row", "n_best", "count_sum"])

    return (blocks.select("block", "rows", "sizes", "links").join(replies, "block")
            .mapInArrow(apply, "row long, n_best long, count_sum long")
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def compose(left: dict, right: dict) -> tuple[dict, tuple | None]:
    """Fragment of two neighbours, and the group that closes between them (place, A ids, B ids).

    ``first`` is the chunk in which the prefix closes; a fragment without one is open all through.
    """
    if left["first"] is None:
        return {**right, "pre_a": left["pre_a"] + right["pre_a"], "pre_b": left["pre_b"] + right["pre_b"]}, None
    if right["first"] is None:
        return {**left, "suf_a": left["suf_a"] + right["pre_a"], "suf_b": left["suf_b"] + right["pre_b"]}, None
    closed = (right["first"], left["suf_a"] + right["pre_a"], left["suf_b"] + right["pre_b"])
    return {**left, "suf_a": right["suf_a"], "suf_b": right["suf_b"]}, closed


NODE = pa.schema([("row", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()), ("first", pa.int32()),
                  ("groups", pa.string()), *((n, pa.list_(pa.int32())) for n in ("pre_a", "pre_b", "suf_a", "suf_b"))])
NODE_DDL = ("row long, node long, chunk int, first int, groups string, pre_a array<int>, pre_b array<int>, "
            "suf_a array<int>, suf_b array<int>")


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def reduce_nodes(rows: pa.Table) -> pa.Table:
    """One level of the tree: the fragment of up to :data:`FAN` neighbours, and the groups they close."""
    parts = sorted(rows.to_pylist(), key=lambda part: part["node"])
    whole, closed = parts[0], []
    for part in parts[1:]:
        whole, group = compose(whole, part)
        closed += [group] if group else []
    row, node = parts[0]["row"], parts[0]["node"] // FAN
    return pa.Table.from_pylist(
        [{**whole, "node": node}, *({"row": row, "chunk": at, "groups": group_text(a, b)} for at, a, b in closed)],
        schema=NODE)


def boundary_groups(long: DataFrame) -> DataFrame:
    """(row, chunk, groups): groups of long texts that span chunks, at the chunk in which they close."""
    nodes = cut(long.select(
        "row", F.col("chunk").cast("long").alias("node"), F.lit(None).cast("int").alias("chunk"),
        F.when(F.col("n_groups") > 0, F.col("chunk")).alias("first"), F.lit(None).cast("string").alias("groups"),
        "pre_a", "pre_b", "suf_a", "suf_b"))
    most = nodes.agg(F.max("node")).first()[0] or 0  # one number
    closed = []
    while most > 0:
        most //= FAN
        level = cut(nodes.withColumn("up", F.floor(F.col("node") / FAN)).groupBy("row", "up")
                    .applyInArrow(reduce_nodes, NODE_DDL))
        closed.append(level.where(F.col("node").isNull()).select("row", "chunk", "groups"))
        nodes = level.where(F.col("node").isNotNull())
    texts = F.concat_ws("|", *(F.array_join(F.col(c).cast("array<string>"), ",") for c in ("pre_a", "pre_b")))
    out = nodes.select("row", F.col("first").alias("chunk"), texts.alias("groups"))
    for part in closed:
        out = out.unionByName(part)
    return out


def group_pieces(found: DataFrame) -> DataFrame:
    """(row, chunk, part, groups): the groups of long texts as pieces of text in order."""
    long = found.where((F.col("chunks") > 1) & F.col("ok"))
    inner = long.where(F.col("groups").isNotNull()).select("row", "chunk", F.lit(1).alias("part"), "groups")
    return boundary_groups(long).select("row", "chunk", F.lit(0).alias("part"), "groups").unionByName(inner)


def aligned_groups(docs: DataFrame, paths: tuple[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, chunk, part, groups): ``a1,a2|b1;a3|b2`` of every text, long ones in ordered pieces."""
    found = fragments(docs, paths, chunk)
    whole = found.where((F.col("chunks") == 1) & F.col("ok")).select(
        "row", "chunk", F.lit(1).alias("part"), "groups")
    ids = found.where(F.col("chunk") == 0).select("row", "doc_id")
    return whole.unionByName(group_pieces(found)).join(ids, "row")


def digests(found: DataFrame) -> DataFrame:
    """(row, groups_sha256) of long texts: the pieces of a text are hashed as they come."""
    def run(batches):
        row, state = None, None
        for source in batches:
            rows, texts = source.column("row").to_pylist(), source.column("groups").to_pylist()
            done = []
            for at, text in zip(rows, texts):
                if at != row:
                    if state is not None:
                        done.append((row, state.hexdigest()))
                    row, state = at, hashlib.sha256(text.encode())
                else:
                    state.update(b";" + text.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"row": r, "groups_sha256": s} for r, s in done], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"row": row, "groups_sha256": state.hexdigest()}], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("groups_sha256", pa.string())])
    return (group_pieces(found).repartition("row").sortWithinPartitions("row", "chunk", "part")
            .select("row", "groups").mapInArrow(run, "row long, groups_sha256 string"))


def alignment_digests(docs: DataFrame, paths: tuple[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Numbers of tokens, groups and links, sums over the corpus-wide counts, and a digest per text.

    Null and empty texts and those a tokenizer does not give back byte by byte have zeros and
    an empty digest; a null ``doc_id`` stays null; repeated rows are answered each and count
    each; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
    """
    found = fragments(docs, paths, chunk, digest=True)
    numbers = ["n_a", "n_b", "n_groups"]
    whole = found.where(F.col("chunks") == 1).select(
        "row", "doc_id", "ok", *numbers, F.col("groups").alias("groups_sha256"))
    long = (found.where(F.col("chunks") > 1).groupBy("row")
            .agg(F.first("doc_id").alias("doc_id"), F.first("ok").alias("ok"), *(F.sum(c).alias(c) for c in numbers))
            .join(digests(found), "row", "left"))
    rows = whole.unionByName(long).join(link_sums(found), "row", "left")

    def shown(column: str):
        return F.when(F.col("ok"), F.coalesce(F.col(column), F.lit(0))).otherwise(F.lit(0)).alias(column)

    return rows.withColumn("n_links", F.col("n_groups")).select(
        "doc_id", *(shown(c) for c in (*numbers, "n_links", "n_best", "count_sum")),
        F.when(F.col("ok"), F.col("groups_sha256")).otherwise(F.lit("")).alias("groups_sha256"))
