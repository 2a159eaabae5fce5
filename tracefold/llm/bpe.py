"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

The encoder never looks at a whole word.  A sequence of tokens is what the merges give
exactly when each neighbouring pair is (the pair would not have merged otherwise), so the
last token of every prefix follows from the last tokens of shorter prefixes, and no
further back than the longest token of the merge list: that length is the sufficient
lookahead.  A boundary on the paths of all prefixes in that window can no longer change,
so the tokens before it are emitted and forgotten; memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracefold.llm.common import binary
from tracefold.llm.pretokens import Encoder
from tracefold.llm.textcore import slices

TOKENIZER = "word_bpe_49k.json"


def byte_chars() -> list[str]:
    """Printable character of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Transducer:
    """Encodes one word (bytes) symbol by symbol; ``end`` is the suffix of word-final symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.end = end
        self.inner: dict[bytes, int] = {}   # tokens inside a word, by their bytes
        self.final: dict[bytes, int] = {}   # tokens that close a word
        self.made: dict[int, int] = {}      # token → rank of its merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if c not in self.made:
                self.made[c], self.parts[c] = rank, (a, b)
        for name, token in vocab.items():
            closes = bool(end) and name.endswith(end)
            body = name[:-len(end)] if closes else name
            if body and all(c in back for c in body) and (len(body) == 1 or token in self.made):
                (self.final if closes else self.inner)[bytes(back[c] for c in body)] = token
        if not end:
            self.final = self.inner
        self.lookahead = max(map(len, [*self.inner, *self.final]), default=1)
        self.self_made = {t: self._holds(t) for t in {*self.inner.values(), *self.final.values()}}
        self.inner = {k: t for k, t in self.inner.items() if self.self_made[t]}
        self.final = {k: t for k, t in self.final.items() if self.self_made[t]}

    def _holds(self, token: int) -> bool:
        """A token stands for itself when its two halves are a pair up to its own merge."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._pair(left, right, self.made[token]) and self._holds(left) and self._holds(right)

    def _pair(self, left: int, right: int, limit: int) -> bool:
        """No merge before ``limit`` joins the two tokens across their boundary.

        Goes back in time: the younger token is undone (on a tie the right one, since equal
        merges run from the left), and a merge across the boundary that would have come
        earlier shows that the pair cannot stand.
        """
        made, parts, rank = self.made, self.parts, self.rank
        while True:
            across = rank.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def pair(self, left: int, right: int) -> bool:
        return self._pair(left, right, 1 << 60)

    def _last(self, word: bytes, i: int, table: dict[bytes, int], last: list, base: int) -> int:
        """Last token of the prefix of length ``i``; ``last[j - base]`` knows the shorter ones."""
        for size in range(min(self.lookahead, i), 0, -1):
            token = table.get(word[i - size - base:i - base])
            if token is not None:
                if size == i:
                    return token
                before = last[i - size - base]
                if before is not None and self.pair(before[0], token):
                    return token
        raise ValueError("no token ends here")

    def encode(self, word: bytes) -> list[int]:
        return list(self.stream([word]))

    def stream(self, blocks) -> Iterator[int]:
        """Ids of one word that arrives in blocks of bytes."""
        held, base, last, n = b"", 0, [None], 0
        window = 4 * self.lookahead
        iterator = iter(blocks)
        block = next(iterator, b"")
        while block:
            following = next(iterator, b"")
            for k in range(0, len(block), window):
                part = block[k:k + window]
                closing = not following and k + window >= len(block)
                held += part
                stop = n + len(part) - closing
                while n < stop:
                    n += 1
                    token = self._last(held, n, self.inner, last, base)
                    last.append((token, self.size(token)))
                if closing:
                    n += 1
                    token = self._last(held, n, self.final, last, base)
                    out, i = [token], n - self.size(token)
                    while i > base:
                        out.append(last[i - base][0])
                        i -= last[i - base][1]
                    yield from reversed(out)
                    return
                if n - base > 2 * window:
                    stable = self.stable(last, base, n)
                    if stable > base:
                        out, i = [], stable
                        while i > base:
                            out.append(last[i - base][0])
                            i -= last[i - base][1]
                        yield from reversed(out)
                        held, last = held[stable - base:], last[stable - base:]
                        base = stable
            block = following

    def stable(self, last: list, base: int, n: int) -> int:
        """The furthest boundary that every prefix a later token can start from goes through."""
        live = set(range(max(base, n - self.lookahead), n + 1))
        while len(live) > 1:
            i = max(live)
            live.discard(i)
            live.add(i - last[i - base][1] if i > base else base)
        return live.pop()

    def size(self, token: int) -> int:
        return self.sizes[token]

    @property
    def sizes(self) -> dict[int, int]:
        if not hasattr(self, "_sizes"):
            self._sizes = {t: len(b) for table in (self.inner, self.final) for b, t in table.items()}
        return self._sizes


def lower(text: str) -> str:
    """NFC and lower case, character by character (a final sigma gets no form of its own)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=4)
def load(path: str):
    """Transducer, batch encoder and decoder of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    machine = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {**{i: s for s, i in model["vocab"].items()}, **{i: s for s, i in special.items()}}

    def words(found: list[str]) -> list[list[int]]:
        return [machine.encode(word.encode("utf-8", "replace")) for word in found]

    encoder = Encoder(words, spaced=False, normalize=lower, special=special)
    return machine, encoder, Decoder(names, spec.get("decoder"))


class Decoder:
    """Ids to text; a byte-level decoder is fed through an incremental UTF-8 state machine."""

    def __init__(self, names: dict[int, str], decoder: dict | None):
        self.joined = decoder is None
        back = {c: b for b, c in enumerate(byte_chars())}
        size = max(names) + 1
        raw = [b""] * size
        for token, name in names.items():
            raw[token] = (name.encode() if self.joined or not all(c in back for c in name)
                          else bytes(back[c] for c in name))
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of tokens; without a decoder tokens are joined by a blank."""
        if not self.joined:
            return slices(self.flat, self.starts[ids], self.sizes[ids]).tobytes()
        if not len(ids):
            return b""
        sizes = self.sizes[ids] + 1
        out = slices(np.append(self.flat, np.uint8(32)), self.starts[ids], sizes).copy()
        out[np.cumsum(sizes) - 1] = 32
        return out[:-1].tobytes()

    def stream(self, blocks) -> Iterator[str]:
        """Text of ids that arrive in blocks; a character split over blocks waits for its rest."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        first = True
        for ids in blocks:
            if len(ids):
                lead = b"" if first or not self.joined else b" "
                first = False
                text = machine.decode(lead + self.bytes_of(np.asarray(ids)))
                if text:
                    yield text
        rest = machine.decode(b"", True)
        if rest:
            yield rest


#: Ids decoded at a time.
BLOCK = 1 << 16


def token_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every whole text.

    Null and empty texts give no ids; strings of special tokens become their ids; every
    input row comes back, in no particular order.
    """
    file = path or token_path(TOKENIZER)

    def run(batches):
        encoder = load(file)[1]
        for batch in batches:
            for first, last, ids, counts in encoder.encode(batch.column("text")):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"])

    return binary(docs).mapInArrow(run, "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number and SHA-256 of the ids of each text, and SHA-256 of what they decode to.

    Null and empty texts have no ids and the digests of nothing; a null ``doc_id`` stays null;
    very long texts are encoded in stretches and decoded in blocks; repeated rows are answered
    each, an empty table gives no rows, columns other than ``doc_id`` and ``text`` are ignored.
    """
    file = path or token_path(TOKENIZER)

    def run(batches):
        _, encoder, decoder = load(file)
        for batch in batches:
            for first, last, ids, counts in encoder.encode(batch.column("text")):
                ends = np.cumsum(counts)
                coded, decoded = [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    own = ids[a:b]
                    coded.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text = hashlib.sha256()
                    for piece in decoder.stream(own[k:k + BLOCK] for k in range(0, len(own), BLOCK)):
                        text.update(piece.encode("utf-8"))
                    decoded.append(text.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(counts, pa.int64()),
                     pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return binary(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every whole text and the text they decode to."""
    file = path or token_path(TOKENIZER)

    def run(batches):
        _, encoder, decoder = load(file)
        for batch in batches:
            for first, last, ids, counts in encoder.encode(batch.column("text")):
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                decoded = ["".join(decoder.stream(ids[k:min(k + BLOCK, b)] for k in range(a, b, BLOCK)))
                           for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                     pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return binary(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
