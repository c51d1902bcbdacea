"""Exact merge-type encoding by backtracking, and decoding (operator 10).

A text becomes ``▁`` + text with every space as ``▁``.  No piece holds a ``▁`` after another
character, and characters that are in no piece never merge, so a text falls apart into chunks
(a run of ``▁`` and what follows it, or one foreign character) that can be encoded alone.  A
chunk is encoded without a merge queue: an Aho-Corasick automaton finds the longest piece at a
position; a piece may follow another only if merging their joined characters gives just these
two again; a bitfield marks positions from which no way on was found, and the search steps back
over them.  Bytes stand for foreign characters.

Defined results: null and empty texts have the end id only and decode to an empty text;
repeated rows are encoded separately; only the id and text columns are read, and other columns
are dropped.  Memory: one Arrow batch, and memos of chunks and pairs of at most twice ``MEMO`` entries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from geoloom.llm.text import bound_batches

#: Entries of each of the two generations of encoded chunks and of judged pairs; a full young one takes the old one's place.
MEMO = 300_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Codec:
    """Encoder and decoder of one merge-type model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        self.text_of = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = [p.score for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.eos = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == "</s>")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a word mark after another character")
        self.known = set("".join(self.id_of)) & set(self.id_of)
        self.trie = ahocorasick.Automaton()
        #: Pieces by their characters; one that no merges lead to is never taken.
        self.taken = {p: i for p, i in self.id_of.items() if self.merged(p) == [i]}
        self.size = [len(p) for p in self.text_of]
        self.longest_size = max(map(len, self.taken))
        #: The next shorter piece that a piece begins with.
        self.shorter: dict[int, int | None] = {i: next((self.taken[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.taken), None) for p, i in self.taken.items()}
        for p, i in self.taken.items():
            self.trie.add_word(p, (i, len(p)))
        self.trie.make_automaton()
        # A line end that is in no longer piece is a chunk by itself: fewer chunks differ.
        longer = set("".join(p for p in self.id_of if len(p) > 1))
        alone = "".join(c for c in "\n\r" if c not in longer)
        self.chunks = re.compile((f"[{alone}]|" if alone else "") + f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")
        self.memo: dict[str, tuple[int, str, str | None]] = {}
        self.old_memo: dict[str, tuple[int, str, str | None]] = {}
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}

    # -- encoding ---------------------------------------------------------------

    def merged(self, chars: str) -> list[int]:
        """Plain merging, the best score first and the leftmost among equals; for short strings."""
        parts = list(chars)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return [self.id_of.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMO:
                self.old_pairs, self.pairs = self.pairs, {}
            if (known := self.old_pairs.get(key)) is None:
                known = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
            self.pairs[key] = known
        return known

    def backtrack(self, chars: str) -> list[int]:
        """Ids of a string of known characters."""
        # The search's first try: the longest piece at each place.  Where all neighbours fit, it ends here.
        ids = [v[0] for _, v in self.trie.iter_long(chars)]
        known, last = self.pairs, ids[0]
        for i in ids[1:]:
            fit = known.get(last << 32 | i)
            if fit is None:
                fit = self.fits(last, i)
                known = self.pairs
            if not fit:
                break
            last = i
        else:
            return ids
        n, size, shorter, failed = len(chars), self.size, self.shorter, bytearray(len(chars) + 1)
        ids, pos, i = [], 0, self.longest(chars, 0)
        while True:
            while i is not None:
                if not failed[pos + size[i]] and (not ids or self.fits(ids[-1], i)):
                    break
                i = shorter[i]
            if i is None:
                # No way on from here: mark the place and shorten the piece before it.
                failed[pos] = 1
                if not ids:
                    raise ValueError(f"no encoding: {chars!r}")
                i = ids.pop()
                pos -= size[i]
                i = shorter[i]
                continue
            ids.append(i)
            pos += size[i]
            if pos == n:
                return ids
            i = self.longest(chars, pos)

    def longest(self, chars: str, pos: int) -> int:
        """The longest piece at a place: the automaton's path may go a little beyond it."""
        n = self.trie.longest_prefix(chars[pos : pos + self.longest_size])
        while (i := self.taken.get(chars[pos : pos + n])) is None:
            n -= 1
        return i

    def encode_chunk(self, chunk: str) -> list[int]:
        if all(c in self.known for c in chunk):
            return self.backtrack(chunk)
        ids: list[int] = []
        run = ""
        for c in chunk:
            if c in self.known:
                run += c
                continue
            if run:
                ids += self.backtrack(run)
                run = ""
            ids += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids + self.backtrack(run) if run else ids

    def forget(self) -> None:
        """Give the memos' memory back: a worker that waits for its next task, or does other work, holds none."""
        for memo in (self.memo, self.old_memo, self.pairs, self.old_pairs):
            memo.clear()

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(MARK + text.replace(" ", MARK)) if text else []

    def entry(self, chunk: str) -> tuple[int, str, str | None]:
        """Number of ids, the ids as decimals, the decoded characters if they aren't the chunk's own."""
        if (e := self.memo.get(chunk)) is None:
            if (e := self.old_memo.get(chunk)) is None:
                ids = self.encode_chunk(chunk)
                plain = self.pieces(ids)
                e = (len(ids), " ".join(map(str, ids)), None if plain == chunk.replace(MARK, " ") else plain)
            if len(chunk) <= 256:
                if len(self.memo) >= MEMO:
                    self.old_memo, self.memo = self.memo, {}
                self.memo[chunk] = e
        return e

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for c in self.split(text or "") for i in self.entry(c)[1].split(" ")] + [self.eos]

    # -- decoding ---------------------------------------------------------------

    def pieces(self, ids: list[int]) -> str:
        """Characters of ids: control ids are silent, runs of byte ids are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == NORMAL:
                out.append(self.text_of[i])
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.pieces(ids).removeprefix(" ")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens with the end id, sha256 of the ids, sha256 of the decoded text."""
        memo = self.memo
        chunks = self.split(text or "")
        found = [memo.get(c) for c in chunks]
        if None in found:
            found = [e or self.entry(c) for e, c in zip(found, chunks, strict=True)]
        n = sum([e[0] for e in found]) + 1
        ids = " ".join([e[1] for e in found] + [str(self.eos)])
        own = [e[2] for e in found]
        if own.count(None) == len(own):
            plain = (text or "").replace(MARK, " ")
        else:
            plain = "".join([c.replace(MARK, " ") if p is None else p for c, p in zip(chunks, own, strict=True)]).removeprefix(" ")
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for a Python worker; a task empties its memos when it ends."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows a few at a time, so that long texts don't all stand twice in memory."""
    for k in range(0, batch.num_rows, 256):
        part = batch.slice(k, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int, the end id last) of each row."""

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = list(_rows(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for _, t in rows], pa.list_(pa.int32()))], ["key", "ids"])
        c.forget()

    bound_batches(df)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of each row of ids; null ids give an empty text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for _, x in _rows(b)], pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, without shipping the ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            n, i, d = [], [], []
            for _, t in _rows(b):
                x = c.digests(t)
                n.append(x[0])
                i.append(x[1])
                d.append(x[2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    bound_batches(df)
    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """docs with token_ids, n_tokens and decoded (the text that the ids give back) behind their columns.

    A column of docs that has one of these names comes back with ``_in`` behind its name.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["row", "token_ids", "decoded"])
        c.forget()

    bound_batches(docs)
    ours = ("token_ids", "n_tokens", "decoded")
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"{c}_in" if c in ours else c) for c in docs.columns]).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType
    out = rows.mapInArrow(run, StructType([StructField("row", kind), StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))
    return out.select("row.*", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
