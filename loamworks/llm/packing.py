"""Packing of token ids into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from bisect import insort
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: White space to Python that the tokenizers' rules may treat as signs; letters whose lower case may differ by library.
ODD = re.compile("[\x85\xa0\u0130\u0250-\U0010ffff]")
#: A stop or comma that is part of a longer run of signs, which stays one word.
RUN = re.compile(r"[.,](?<=[\W_][.,])(?<!\s[.,])\s")
PLAIN = re.compile(r"[^ \t-\r]+")
MOST_WORDS = 900_000  # words whose ids a worker remembers


class Encoder:
    """Ids of whole texts, word by word with a bounded memory of words.

    Right for tokenizers that lower case, never look across white space, and mark the last id of
    a word, such as word_bpe_49k; others must set `whole`.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tok, self.whole, self.known = Tokenizer.from_file(path), whole, {}
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def words(self, text: str) -> list[str]:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and ODD.search(text):
            return PLAIN.findall(text)
        text = text.lower()
        if not RUN.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha()]
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for w, end in zip(part, ends.tolist(), strict=True):
                    self.known[w] = data[at:end]
                    at = end
        if rest := [w for w in new if w not in self.known]:
            for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.known[w] = np.asarray(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers."""
        if self.whole:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        rows, known = [self.words(t) for t in texts], self.known
        if len(known) > MOST_WORDS:
            known.clear()
        if new := set().union(*rows).difference(known):
            self._learn(list(new))
        return [b"".join([known[w] for w in row]) for row in rows]


@lru_cache(maxsize=1)
def encoder(path: str, whole: bool) -> Encoder:
    """A worker's encoder, with the words that its earlier tasks have met."""
    return Encoder(path, whole)


class Pool:
    """Pieces shorter than a sequence, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.pieces, self.lengths, self.size = capacity, {}, [], 0

    def add(self, length: int, piece: tuple) -> None:
        if length not in self.pieces:
            self.pieces[length] = []
            insort(self.lengths, length)
        self.pieces[length].append(piece)
        self.size += 1

    def take(self, length: int) -> tuple:
        row = self.pieces[length]
        piece = row.pop()
        if not row:
            del self.pieces[length]
            self.lengths.remove(length)
        self.size -= 1
        return piece

    def fill(self) -> list[tuple[int, tuple]]:
        """The pieces of one sequence: the longest, and of the others a multiset that leaves the least slack.

        Subset sums are a bitset; each length enters in powers of two of its count, and the
        chosen counts are traced back through the bitsets kept before each entry.
        """
        seed = self.lengths[-1]
        out = [(seed, self.take(seed))]
        room = self.capacity - seed
        if room and self.lengths:
            full, bits, steps = (1 << (room + 1)) - 1, 1, []
            for length in reversed(self.lengths):
                if length > room:
                    continue
                left, k = min(len(self.pieces[length]), room // length), 1
                while left:
                    k = min(k, left)
                    steps.append((length, k, bits))
                    bits |= (bits << (length * k)) & full
                    left -= k
                    k *= 2
                if bits >> room & 1:
                    break
            total = bits.bit_length() - 1
            for length, k, before in reversed(steps):
                if not before >> total & 1:
                    total -= length * k
                    out += [(length, self.take(length)) for _ in range(k)]
        return out


def runs(batches, most: int = 500_000):
    """Part, ids and texts of successive rows of one part, of about `most` characters together; without a third column all are of part None."""
    now, docs, texts, size = None, [], [], 0
    for batch in batches:
        parts = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc, text, part in zip(batch.column(0).to_pylist(), batch.column(1), parts, strict=True):
            if docs and (size > most or part != now):
                yield now, docs, texts
                docs, texts, size = [], [], 0
            now = part
            docs.append(doc)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
    if docs:
        yield now, docs, texts


def packer(capacity: int, path: str, eos: int, whole: bool, least: int):
    def run(batches):
        task = TaskContext.get()
        base, now = (task.partitionId() if task else 0) << 33, None
        encode, pool, n = encoder(path, whole), Pool(capacity), 0
        tail = np.asarray([eos], "<u4").tobytes()

        def rows(pieces):
            return pa.RecordBatch.from_pydict(dict(zip(SCHEMA.replace(" long", "").split(", "), map(lambda c: pa.array(c, pa.int64()), zip(*pieces, strict=True)), strict=True)))

        out = []

        def close():
            nonlocal n
            at = 0
            for length, (doc, start, crc, total) in pool.fill():
                out.append((doc, start, length, crc, total, base + n, at))
                at += length
            n += 1

        for part, docs, texts in runs(batches):
            if part != now:
                while pool.size:
                    close()
                base, now, n = part << 26, part, 0
            for doc, ids in zip(docs, encode(texts), strict=True):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    if len(part) == 4 * capacity:
                        out.append((doc, start, capacity, zlib.crc32(part), total, base + n, 0))
                        n += 1
                    else:
                        pool.add(len(part) // 4, (doc, start, zlib.crc32(part), total))
                while pool.size > 2 * least:
                    close()
                if len(out) >= 20_000:
                    yield rows(out)
                    out.clear()
        while pool.size:
            close()
        if out:
            yield rows(out)

    return run


def _parts(docs: DataFrame) -> Column:
    """A number for each split of the files that docs are read from, which rises in the order in which the rows were written; else that of the partition."""
    try:
        docs.select("_metadata.file_name", "_metadata.file_block_start")
    except AnalysisException:
        return F.spark_partition_id().cast("long")
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.pmod(F.xxhash64(name), F.lit(1 << 20)))
    return F.shiftleft(number, 14) + F.shiftright(F.col("_metadata.file_block_start"), 20)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, eos: int = 1, whole: bool = False, least: int = 1024, in_order: bool = False) -> DataFrame:
    """Packs the ids of each text, with `eos` after them, into sequences of at most `capacity` ids.

    A document's ids are cut at multiples of `capacity`; full pieces are sequences by
    themselves, and what is left over is packed within its scan partition by minimum bin
    slack, so there is no shuffle. A partition keeps at most about 2 * `least` open pieces
    (five numbers each), and ends with at most a few sequences that are not full; it gives
    the same rows when a lost task runs again. `tokenizer` is the path of a `tokenizers`
    file, read on the workers.

    With `in_order` each split of a file that Spark has written is packed by itself, and sequence_id rises from
    one to the next in the order in which their rows were written; inside a split it follows that order but for the open pieces.

    Null and empty texts: one piece that holds `eos` alone. Repeated rows: packed as often as
    they occur. Null doc_id: kept as null. Very long texts: as many pieces as needed. Empty
    table: no rows. Columns besides doc_id and text are not read.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    more = [_parts(docs).alias("part")] if in_order else []
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), *more).mapInArrow(lean(packer(capacity, path, eos, whole, least)), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
