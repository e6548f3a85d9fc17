"""Benchmark decontamination: a generalised suffix automaton of the normalised test
items; training tokens stream through it and the longest matching lengths say
which words lie inside an item's window.

Tasks cut the items into pieces, and prefix sums of their numbers of words deal them to
shards of at most ``SHARD_WORDS`` words. One shard is built on the driver; the automata of
more are each built in a task, and the driver holds and sends one after the other, so both
have a fixed bound. More items mean more passes over the documents, whose findings are
united per document.

Cases: a null or empty text has no words, no hits and isn't contaminated; items
that are null or have no word are nothing; repeated item ids count once; repeated
documents are judged each; an empty benchmark hits nothing; null document ids are
kept as they are. Very long texts are read whole, in slices of a batch."""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from menuloom.session import reliable_checkpoint

from .common import arrived, map_texts, rewrite_texts, travelling, utf8

WINDOW = 13
#: Most words of benchmark items in one automaton (about 250 bytes a word in a task).
SHARD_WORDS = 100_000
#: A document is contaminated if hit words are at least one in so many.
COVERAGE = 20

_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def normal_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, a-z and characters beyond ASCII."""
    return [] if text is None else utf8(text).lower().translate(_TO_SPACE).split()


class Automaton:
    """Suffix automaton of several word sequences. ``follow[s]`` maps a word number to
    the next state, ``link`` is the state of the longest suffix in another class and
    ``size`` the longest match of a state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.follow, self.link, self.size = [{}], [-1], [0]
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min((min(len(ids), window) for _, ids in sequences), default=0)
        pairs = {(a << 32) | b for _, ids in sequences for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.anchor = self._anchors()
        # Names of the items that own a window: by state for full windows, by state
        # and length for items shorter than a window.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for name, ids in sequences:
            state = length = 0
            for w in ids:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.full.setdefault(self.anchor[state], set()).add(name)
            if len(ids) < window:
                while self.size[self.link[state]] >= len(ids):
                    state = self.link[state]
                own = self.short.setdefault(state, [])
                found = next((names for size, names in own if size == len(ids)), None)
                if found is None:
                    own.append((len(ids), {name}))
                else:
                    found.add(name)
        self.short_up = self._short_ancestors()

    def _extend(self, last: int, w: int) -> int:
        follow, link, size = self.follow, self.link, self.size
        known = follow[last].get(w)
        if known is not None:
            return known if size[known] == size[last] + 1 else self._split(last, w, known)
        new = self._state(size[last] + 1, {})
        at = last
        while at != -1 and w not in follow[at]:
            follow[at][w] = new
            at = link[at]
        if at == -1:
            link[new] = 0
        else:
            other = follow[at][w]
            link[new] = other if size[other] == size[at] + 1 else self._split(at, w, other)
        return new

    def _state(self, size: int, follow: dict) -> int:
        self.follow.append(follow)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, w: int, other: int) -> int:
        """A state for the shorter strings of ``other`` that end in ``w`` after ``at``."""
        copy = self._state(self.size[at] + 1, dict(self.follow[other]))
        self.link[copy] = self.link[other]
        self.link[other] = copy
        while at != -1 and self.follow[at].get(w) == other:
            self.follow[at][w] = copy
            at = self.link[at]
        return copy

    def _by_size(self) -> list[int]:
        return sorted(range(1, len(self.size)), key=self.size.__getitem__)

    def _anchors(self) -> list[int]:
        """For each state that holds matches of a whole window, the state of the
        window that ends there."""
        anchor = [0] * len(self.size)
        for s in self._by_size():
            up = self.link[s]
            anchor[s] = anchor[up] if self.size[up] >= self.window else s
        return anchor

    def _short_ancestors(self) -> list[int]:
        """The nearest state up the links, itself included, that owns a short item."""
        up = [0] * len(self.size)
        for s in self._by_size():
            up[s] = s if s in self.short else up[self.link[s]]
        return up

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest match after one more word."""
        follow = self.follow
        while True:
            to = follow[state].get(w)
            if to is not None:
                return to, length + 1
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.size[state]

    def scan(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end position, window length, item names) for every window in a run."""
        state = length = 0
        for i, w in enumerate(ids):
            state, length = self.step(state, length, w)
            if length >= self.window:
                yield i + 1, self.window, self.full[self.anchor[state]]
            at = self.short_up[state]
            while at:
                for size, names in self.short[at]:
                    if size <= length:
                        yield i + 1, size, names
                at = self.short_up[self.link[at]]

    def hits(self, texts: list) -> list[tuple[int, list[list[int]], list[str]]]:
        """For each text its number of words, merged word spans and item names."""
        words = [normal_words(t) for t in texts]
        out = [(len(w), [], []) for w in words]
        if not self.shortest or not any(words):
            return out
        number = self.vocabulary.get
        flat: list[int] = []
        starts = []
        for w in words:
            starts.append(len(flat))
            flat.extend(map(number, w, [-1] * len(w)))
            flat.append(-1)
        ids = np.array(flat, np.int64)
        for begin, end in self._runs(ids):
            d = int(np.searchsorted(starts, begin, "right")) - 1
            spans, names = out[d][1], out[d][2]
            for stop, size, found in self.scan(flat[begin:end]):
                spans.append([begin - starts[d] + stop - size, begin - starts[d] + stop])
                names.extend(found)
        return [(n, merged(spans), sorted(set(names) - {None})) if spans else (n, spans, names) for n, spans, names in out]

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches in which every word and pair of neighbours occurs in some item
        and that are long enough for a window; no match goes beyond one."""
        known = ids >= 0
        joined = np.zeros(len(ids), bool)  # with the word before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs) and len(both):
            code = (ids[both - 1] << 32) | ids[both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[both[self.pairs[at] == code]] = True
        first = np.flatnonzero(known & ~joined)
        last = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = last - first >= self.shortest
        return list(zip(first[long].tolist(), last[long].tolist()))


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def pieces(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> tuple[DataFrame, int]:
    """Rows (name, words, shard) of the items, and the number of shards. Items longer
    than a tenth of a shard (or two windows) are cut with an overlap of a window less one word, which loses no
    window. A shard holds what starts in its stretch of the running sum of words."""
    most = min(shard_words, max(2 * window, shard_words // 10))
    step = max(1, most - window + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = normal_words(body)
                for start in range(0, max(1, len(words) - window + 1), step) if words else ():
                    piece = words[start : start + step + window - 1]
                    yield pa.RecordBatch.from_pydict({"name": [name], "words": [b" ".join(piece)], "part": [part], "before": [before], "n": [len(piece)]})
                    before += len(piece)

    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("string").alias("body"))
    cut_up = reliable_checkpoint(items.mapInArrow(split, "name string, words binary, part long, before long, n long"))
    sums = sorted(cut_up.groupBy("part").agg(F.sum("n")).collect())  # one row a task
    starts = [0, *itertools.accumulate(n for _, n in sums)]
    if starts[-1] <= shard_words:
        return cut_up.select("name", "words", F.lit(0).cast("long").alias("shard")), int(starts[-1] > 0)
    stretch = max(1, shard_words - max(most, window) + 1)
    offsets = benchmark.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(sums, starts)], "part long, at long")
    dealt = cut_up.join(F.broadcast(offsets), "part").select("name", "words", F.floor((F.col("at") + F.col("before")) / stretch).alias("shard"))
    return dealt, -(-starts[-1] // stretch)


def shards(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> tuple[int, Iterator[Automaton]]:
    """The number of shards, and their automata one after the other."""
    dealt, count = pieces(benchmark, item_id, text, window, shard_words)
    read = lambda names, words: [(n, bytes(w).split()) for n, w in zip(names, words)]
    if count <= 1:
        rows = dealt.collect() if count else []  # no more words than one shard
        return count, iter([Automaton(read([r["name"] for r in rows], [r["words"] for r in rows]), window)] if rows else [])

    def build(table: pa.Table) -> pa.Table:
        machine = Automaton(read(table["name"].to_pylist(), table["words"].to_pylist()), window)
        return pa.table({"state": pa.array([pickle.dumps(vars(machine))], pa.binary())})

    built = reliable_checkpoint(dealt.repartition(count, "shard").groupBy("shard").applyInArrow(build, "state binary"))

    def each() -> Iterator[Automaton]:
        for row in built.toLocalIterator():
            machine = Automaton.__new__(Automaton)
            vars(machine).update(pickle.loads(bytes(row["state"])))
            yield machine

    return count, each()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, sharded: tuple[int, Iterator[Automaton]] | None = None,
) -> DataFrame:
    """Rows (doc_id, n_words, spans, items): the merged spans of words inside an
    occurrence of a window, and the names of the items with occurring windows.
    ``sharded`` is what ``shards`` gave for the benchmark, if that is known already."""
    spark = docs.sparkSession
    fields = [StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))]

    def one(sent, frame: DataFrame) -> DataFrame:
        def make() -> Callable[[list], list]:
            machine = arrived(sent)
            return lambda texts: [list(c) for c in zip(*((n, [{"start": a, "end": b} for a, b in s], i) for n, s, i in machine.hits(texts)))]

        return map_texts(frame, [doc_id], fields, make, text)

    count, machines = sharded or shards(benchmark, item_id, item_text, window, shard_words)
    if count <= 1:
        return one(travelling(spark, next(machines, None) or Automaton([], window)), docs)
    # More than one pass: number the rows once, so that the passes can be united.
    numbered = reliable_checkpoint(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("__row")))
    parts = None
    for machine in machines:
        sent = travelling(spark, machine)
        found = one(sent, numbered.select(F.struct("__row", "__id").alias(doc_id), F.col("__t").alias(text)))
        found = found.select(doc_id, "n_words", F.when(F.size("spans") > 0, F.col("spans")).alias("spans"), "items")
        # The first pass has a row for each document, the others for those they hit.
        found = reliable_checkpoint(found if parts is None else found.where("spans IS NOT NULL"))
        sent.destroy()
        parts = found if parts is None else parts.union(found)
    united = parts.groupBy(doc_id).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    join_in = lambda m, s: F.when((F.size(m) > 0) & (s["start"] <= F.element_at(m, -1)["end"]), F.concat(
        F.slice(m, 1, F.size(m) - 1), F.array(F.struct(F.element_at(m, -1)["start"].alias("start"), F.greatest(F.element_at(m, -1)["end"], s["end"]).alias("end"))),
    )).otherwise(F.concat(m, F.array(s)))
    return united.select(
        F.col(doc_id)["__id"].alias(doc_id), "n_words",
        F.aggregate(F.array_sort("spans"), F.array().cast(ArrayType(SPAN)), join_in).alias("spans"), "items",
    )


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(hit, words, coverage: int = COVERAGE):
    return (hit > 0) & (coverage * hit >= words)


_WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without contaminated ones; from the others the hit spans are cut
    out of the text. Columns stay as they are; texts that nothing hits are untouched.
    With one shard of items it is one pass without a shuffle; with more, the spans
    of all passes are united first, as a document is judged on all of them."""
    pattern = re.compile(_WORD_CHARS)
    count, machines = shards(benchmark, "item_id", "text", window, shard_words)
    if not count:
        return docs

    def judged(texts: list, hits: list) -> tuple[list, list]:
        keep, new = [], []
        for body, (words, spans) in zip(texts, hits, strict=True):
            hit = sum(b - a for a, b in spans)
            bad = bool(contaminated(hit, words, coverage))
            keep.append(not bad)
            new.append(cut(body, spans, pattern) if spans and not bad else body)
        return keep, new

    if count == 1:
        sent = travelling(docs.sparkSession, next(machines))

        def make() -> Callable[[list], tuple[list, list]]:
            automaton = arrived(sent)
            return lambda texts: judged(texts, [h[:2] for h in automaton.hits(texts)])

        return rewrite_texts(docs, make, text)

    names = docs.columns
    numbered = reliable_checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = benchmark_hits(numbered, benchmark, "__row", text, window=window, sharded=(count, machines)).where(F.size("spans") > 0)
    joined = numbered.join(found.select("__row", F.col("n_words").alias("__n"), F.col("spans").alias("__spans")), "__row", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, spans = (batch.column(c).to_pylist() for c in (text, "__n", "__spans"))
            hits = [(n or 0, [[x["start"], x["end"]] for x in s or []]) for n, s in zip(sizes, spans)]
            keep, new = judged(texts, hits)
            columns = {c: batch.column(c) for c in names}
            columns[text] = pa.array(new, columns[text].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(n) if n != o else c for n, o, c in zip(new, texts, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(apply, docs.schema)


def cut(body: str, spans: list[list[int]], pattern) -> str:
    places = [m.span() for m in pattern.finditer(body)]
    out, at = [], 0
    for a, b in spans:
        out.append(body[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, body[at:]])
