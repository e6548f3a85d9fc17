"""Phrase collocations by set-oriented mining (SETM) on occurrence relations.

The relation of length k has a row for each occurrence of a frequent phrase of k words: where it
begins, and the phrase's id. It is kept sorted by piece and position, in blocks of whole pieces that
are written to the shared folder. Places count words and ends of pieces, so the next word of a
piece is one place on, and no place is one on across pieces. A block's row holds its places (as gaps,
nearly all 1) and local numbers of phrases beside the block's list of phrases, both packed.

One length after the other:
1. merge-join: what stands one place apart in the sorted relation makes the next length. Both are
   frequent phrases, as the first and the last words of a frequent phrase are frequent; the pair
   of their ids names the longer phrase exactly, whatever the vocabulary's size;
2. group-count: the pairs, already counted within each block, are summed up by phrase; phrases
   below ``support`` are gone, the others get ids;
3. semi-join: the frequent ids come back to the blocks, in a broadcast while they are at most
   ``SENT`` rows, else by a join on (block, local number) that is as large as the lists. Only what is
   frequent is written as the next relation; the merge-join is made again for that, as its whole
   result would take more room than the counts.

Counts stay integers, scores are decimal divisions. No phrase gathers its occurrences anywhere, so a
hot word or a hot language is rows in many blocks. Words are never hashed.

Cases: null texts are empty; a null language is ``und``, together with languages of that name; documents
without an id count like all others, repeated rows each; a word of any length is a word; a block takes
the whole of a piece, however long; an empty table gives no rows. Extra columns are ignored."""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from menuloom.session import reliable_checkpoint, shared_dir

from .common import remove_folder

LONGEST = 4
SUPPORT = 30
#: Phrases reported of a language.
REPORTED = 2000
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
ABSORBED = 80
SCALE = 2_000_000
#: Words of a block, and bytes of text that are split at a time.
BLOCK = 1_000_000
WINDOW = 4 << 20
#: Frequent phrases of a length that are sent to the tasks, at most.
SENT = 500_000

# A-Z in lower case; the ends of pieces (fixed values) as line feeds.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ \t\n]")
_NAMES = {1: ("lang", "word"), 2: ("g", "h")}
_LISTS = {1: "lang string, word string, n long", 2: "g long, h long, n long"}
_DDL = "block long, occurrences binary, list binary"
_ROW = pa.schema([("block", pa.int64()), ("occurrences", pa.binary()), ("list", pa.binary())])


def _pack(**columns) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _row(block: int, gap: np.ndarray, name: np.ndarray, **listed) -> pa.RecordBatch:
    packed = _pack(gap=pa.array(gap, pa.int64()).cast(pa.int32()), name=pa.array(name, pa.int32())), _pack(**listed)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block, *packed), _ROW, strict=True)], schema=_ROW)


class Block:
    """Occurrences of words in whole pieces, with the list of the words."""

    def __init__(self) -> None:
        self.number = itertools.count()
        self.words: dict[str, defaultdict] = {}
        self.totals: dict[str, int] = {}
        self.at, self.names, self.place, self.size = [], [], 0, 0

    def add(self, lang: str, pieces: list[bytes], fresh: bool) -> None:
        """The words of pieces; ``fresh`` if the first one does not go on with the last before."""
        if lang not in self.words:
            self.words[lang], self.totals[lang] = defaultdict(self.number.__next__), 0
        of_lang, words, lengths = self.words[lang], [], []
        for piece in pieces:
            found = piece.split()
            words += found
            lengths.append(len(found))
        self.place += fresh
        if words:
            self.names.append(np.fromiter(map(of_lang.__getitem__, words), np.int32, len(words)))
            self.at.append(self.place + np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths))
        self.place += len(words) + len(lengths) - 1
        self.size += len(words)
        self.totals[lang] += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        """The block as one row. A word that is null stands for all words of its language."""
        at, names = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.at, self.names))
        found = sorted(((i, lang, word) for lang, words in self.words.items() for word, i in words.items()), key=lambda x: x[0])
        langs, words = [lang for _, lang, _ in found] + list(self.totals), [word.decode("utf-8", "replace") for _, _, word in found] + [None] * len(self.totals)
        n = np.bincount(names, minlength=len(found)).tolist() + list(self.totals.values())
        return _row(number, np.diff(at, prepend=0), names, lang=pa.array(langs, pa.string()), word=pa.array(words, pa.string()), n=pa.array(n, pa.int64()))


def word_blocks(docs: DataFrame, block: int, window: int) -> DataFrame:
    """The relation of single words: one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 33, Block()
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, start, fresh = raw.as_py().translate(_PLAIN), 0, True
                while start < len(raw):
                    end = _GAP.search(raw, start + window)
                    end = end.end() if end else len(raw)
                    *whole, last = raw[start:end].split(b"\n")
                    if whole:
                        now.add(lang, whole, fresh)
                        fresh = True
                    if now.size >= block and fresh:
                        yield now.row(number)
                        number, now = number + 1, Block()
                    now.add(lang, [last], fresh)
                    start, fresh = end, False
        if now.words:
            yield now.row(number)

    source = docs.select("lang", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, _DDL)


def merge_join(gap: np.ndarray, name: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a sorted relation and the ids of its local numbers, the candidates of the next length:
    (gap, name, ids of the first part, ids of the rest, counts)."""
    at, name = np.cumsum(gap.astype(np.int64)), name.astype(np.int64)
    first = np.flatnonzero(np.diff(at) == 1)
    code, local = np.unique(name[first] * len(ids) + name[first + 1], return_inverse=True)
    return np.diff(at[first], prepend=0), local, ids[code // max(1, len(ids))], ids[code % max(1, len(ids))], np.bincount(local, minlength=len(code))


def semi_join(gap: np.ndarray, name: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """A relation without what has no id (-1), numbered anew: (gap, name, ids)."""
    there = ids >= 0
    keep = there[name]
    return np.diff(np.cumsum(gap.astype(np.int64))[keep], prepend=0), (np.cumsum(there) - 1)[name[keep]], ids[there]


def candidates(kind: int, occurrences: pa.BinaryScalar, packed: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """(gap, name, list) of a block's candidates: its words, or pairs of its frequent phrases."""
    places, listed = _unpack(occurrences), _unpack(packed)
    gap, name = (places.column(c).to_numpy() for c in ("gap", "name"))
    if kind == 1:
        return gap, name, listed
    gap, name, *arrays = merge_join(gap, name, listed.column("id").to_numpy())
    return gap, name, pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["g", "h", "n"])


def _lookup(length: int, frequent: pa.Table):
    """Plain data that finds ids of a block's list."""
    ids = frequent.column("id").to_numpy()
    if length == 1:
        out: dict[str, dict[str, int]] = {}
        for lang, word, i in zip(frequent.column("lang").to_pylist(), frequent.column("word").to_pylist(), ids.tolist(), strict=True):
            out.setdefault(lang, {})[word] = i
        return out
    g, h = (np.unique(frequent.column(c).to_numpy(), return_inverse=True) for c in ("g", "h"))
    code = g[1].astype(np.int64) * len(h[0]) + h[1]
    order = np.argsort(code)
    return g[0], h[0], code[order], ids[order]


def _found(length: int, listed: pa.RecordBatch, known) -> np.ndarray:
    """The id of each row of a block's list, -1 if it is not frequent."""
    if length == 1:
        nothing: dict[str, int] = {}
        pairs = zip(listed.column("lang").to_pylist(), listed.column("word").to_pylist(), strict=True)
        return np.fromiter((known.get(lang, nothing).get(word, -1) for lang, word in pairs), np.int64, len(listed))
    out = np.full(len(listed), -1, np.int64)
    gs, hs, codes, ids = known
    if len(ids) and len(out):
        g, h = (listed.column(c).to_numpy() for c in ("g", "h"))
        i, j = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((gs, g), (hs, h)))
        code = i.astype(np.int64) * len(hs) + j
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = (gs[i] == g) & (hs[j] == h) & (codes[place] == code)
        out[hit] = ids[place[hit]]
    return out


def lists(blocks: DataFrame, kind: int, places: bool = False) -> DataFrame:
    """The counted candidates of each block; ``places`` adds the block and the local number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, occurrences, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                listed = candidates(kind, occurrences, packed)[2]
                if places:
                    listed = listed.append_column("block", pa.array(np.full(len(listed), block), pa.int64())).append_column("j", pa.array(np.arange(len(listed))))
                yield from (listed.slice(start, 50_000) for start in range(0, len(listed), 50_000))

    return blocks.mapInArrow(run, _LISTS[kind] + (", block long, j long" if places else ""))


def frequent_only(blocks: DataFrame, kind: int, frequent: DataFrame, sent: int) -> DataFrame:
    """The relation of the next length: the blocks' candidates that are frequent."""

    def relation(block: int, gap: np.ndarray, name: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        gap, name, ids = semi_join(gap, name, ids)
        return _row(block, gap, name, id=pa.array(ids, pa.int64()))

    if frequent.count() <= sent:
        known = blocks.sparkSession.sparkContext.broadcast(_lookup(kind, frequent.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, occurrences, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    gap, name, listed = candidates(kind, occurrences, packed)
                    yield relation(block, gap, name, _found(kind, listed, known.value))

        return blocks.mapInArrow(run, _DDL)

    back = lists(blocks, kind, places=True).join(frequent.select("id", *_NAMES[kind]), list(_NAMES[kind])).select(F.col("block").alias("b"), "j", "id")

    def meet(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for block, occurrences, packed in zip(rows.column("block").to_pylist(), rows.column("occurrences"), rows.column("list"), strict=True):
            gap, name, listed = candidates(kind, occurrences, packed)
            ids = np.full(len(listed), -1, np.int64)
            ids[found.column("j").to_numpy()] = found.column("id").to_numpy()
            out.append(relation(block, gap, name, ids))
        return pa.Table.from_batches(out, _ROW)

    return blocks.groupBy("block").cogroup(back.groupBy("b")).applyInArrow(meet, _DDL)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT, reported: int = REPORTED,
    absorbed: int = ABSORBED, block: int = BLOCK, window: int = WINDOW, sent: int = SENT,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): of each language the first phrases by score."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/collocations-{uuid.uuid4().hex}"
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks, phrases, parts = word_blocks(source, block, window), None, []
    for length in range(1, longest + 1):
        kind, path = min(length, 2), f"{folder}/{length}"
        blocks.write.option("compression", "none").parquet(path)
        if length > 1:
            remove_folder(spark, f"{folder}/{length - 1}")
        blocks = spark.read.schema(_DDL).parquet(path)
        counts = lists(blocks, kind).groupBy(*_NAMES[kind]).agg(F.sum("n").alias("f"))
        enough = (F.col("f") >= support) | F.col("word").isNull() if length == 1 else F.col("f") >= support
        fixed = reliable_checkpoint(counts.where(enough))
        if length == 1:
            totals = fixed.where("word IS NULL").select("lang", F.col("f").alias("n"))
            fixed = fixed.where("word IS NOT NULL")
        frequent = fixed.withColumn("id", F.monotonically_increasing_id())
        if length == 1:
            frequent = reliable_checkpoint(frequent)
            phrases = frequent.select("id", "lang", F.col("word").alias("phrase"), "f", F.col("word").alias("last"))
        else:
            first = phrases.select(F.col("id").alias("g"), "lang", F.col("phrase").alias("head"))
            rest = phrases.select(F.col("id").alias("h"), "last")
            phrases = frequent.join(first, "g").join(rest, "h").select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", "last")
            phrases = reliable_checkpoint(phrases)
        parts.append(phrases.select("lang", "phrase", "f", F.lit(length).alias("words")))
        if length < longest:
            blocks = frequent_only(blocks, kind, frequent, sent)
    known = parts[0]
    for more in parts[1:]:
        known = known.union(more)
    known = reliable_checkpoint(known)
    remove_folder(spark, folder)

    part = lambda start, size: F.array_join(F.slice(F.split("phrase", " "), start, size), " ")
    candidates = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")
    sizes = known.select("lang", "phrase", "f")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    cuts = cuts.join(sizes.toDF("lang", "first", "l"), ["lang", "first"]).join(sizes.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(25)) * {SCALE}) div (CAST(l AS DECIMAL(25)) + CAST(r AS DECIMAL(25)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))
    inner = candidates.where("words > 2").select("lang", "a", "phrase", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    around = inner.select("lang", "a", part(F.col("start"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(25)") < absorbed * F.col("a").cast("decimal(25)")))
    best = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reported)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", F.col("x.score").cast("long").alias("score"))
