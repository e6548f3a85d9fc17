"""Substring deduplication by recompression: every document is parsed in rounds that
replace runs of one symbol and chosen pairs of neighbours by new symbols. A name is
a fingerprint of what it stands for, so all tasks give equal strings equal names
without a table of names, and equal stretches of words get the same symbols inside.

1. *Reveal.* Each block of documents sends its symbols, sorted and packed, to buckets by
   name; a bucket answers with one bit a name: whether it occurs twice in the corpus.
2. *Rule out.* Each symbol knows which words decided it. A window that holds all
   those words and whose symbol occurs once can't occur twice. The windows left (those
   without such a symbol included) are candidates.
3. *Verify.* Candidates send 128-bit fingerprints of their whole word sequence to buckets,
   which again answer in bits; words covered by a window that occurs twice go.

So the corpus crosses the network once, the symbols (about one in six words) once,
and only candidate windows beyond that. What a bucket gets from a block holds each
name once, so copies of one passage never gather in a task. Answers go back by block.

Cases: null and empty texts have no words and nothing is removed; a text shorter than the
window loses nothing; copies of one document and repeated rows lose all words of
theirs that windows cover; rows without an id are judged like others; a passage that
overlaps itself (a long run of one word) counts as repeated; columns other than id and
text aren't read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, word_names, words_of

WINDOW = 35
ROUNDS = 6
#: Most words a symbol may stand for.
LONGEST = 8
#: Documents in a block and names of how many documents in a bucket, on average.
BLOCK_DOCS = 256
BUCKET_DOCS = 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class Words:
    """The words of a block of documents, in an order that only depends on the rows."""

    def __init__(self, rows: pa.Table) -> None:
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, str(ids[i]), texts[i] is None, texts[i] or ""))
        self.ids = rows.column("doc_id").combine_chunks().take(pa.array(order, pa.int64())) if order else rows.column("doc_id")
        self.words = [words_of(texts[i]) for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.names = word_names([x for w in self.words for x in w])
        self.doc = np.repeat(np.arange(len(order)), self.sizes)

    def windows(self, window: int) -> np.ndarray:
        """Whether a whole window starts at each word."""
        at = np.arange(len(self.names))
        return at + window <= self.ends[self.doc] if len(at) else np.zeros(0, bool)


def symbols(w: Words, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after the last round, and for each the first and the last word
    position that had a part in making it (one beyond the document at its edges)."""
    name, doc = w.names, w.doc
    n = len(name)
    first, last = np.arange(n), np.arange(n)
    low, high = first.copy(), last.copy()
    name, doc, first, last, low, high = _runs(name, doc, first, last, low, high, longest)
    for r in range(rounds):
        if len(name) < 2:
            break
        left = (mix(name + np.uint64((r + 1) * int(_STEP) % 2**64)) >> np.uint64(63)).astype(bool)
        size = last - first + 1
        near = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & near & (size[:-1] + size[1:] <= longest)
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # What stays alone as a left part depends on what follows, as a right part on what comes before.
        new_low, new_high = low.copy(), high.copy()
        after = np.append(np.where(near, high[1:], last[:-1] + 1), last[-1] + 1)
        before = np.append(first[:1] - 1, np.where(near, low[:-1], first[1:] - 1))
        alone = left & ~pair
        new_high[alone] = np.maximum(high, after)[alone]
        alone = ~left & ~second
        new_low[alone] = np.minimum(low, before)[alone]
        head = np.flatnonzero(pair)
        made = mix(name[head] * _STEP + mix(name[head + 1]) + np.uint64(r + 1))
        name, last = name.copy(), last.copy()
        name[head], last[head] = made, last[head + 1]
        new_low[head] = np.minimum(low[head], low[head + 1])
        new_high[head] = np.maximum(high[head], high[head + 1])
        keep = ~second
        name, doc, first, last, low, high = name[keep], doc[keep], first[keep], last[keep], new_low[keep], new_high[keep]
    return name, low, high


def _runs(name, doc, first, last, low, high, longest):
    """Runs of one word up to ``longest`` become a symbol; longer ones stay as they are."""
    n = len(name)
    if n < 2:
        return name, doc, first, last, first - 1, last + 1
    near = doc[1:] == doc[:-1]
    start = np.append(True, (name[1:] != name[:-1]) | ~near)
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, n))
    run = np.repeat(np.arange(len(at)), length)
    long = length[run] > longest
    # The end of a run is seen by the word after it; of a long one, enough of it is.
    low = np.where(long, np.maximum(at[run], first - longest), at[run] - 1)
    high = np.where(long, np.minimum(at[run] + length[run] - 1, low + longest), at[run] + length[run])
    low = np.where(long, np.minimum(low, np.maximum(at[run], high - longest)), low)
    keep = start | long
    short = np.flatnonzero(start & ~long & (length[run] > 1))
    name, last = name.copy(), last.copy()
    name[short] = mix(name[short] * _STEP + length[run][short].astype(np.uint64))
    last[short] += length[run][short] - 1
    return name[keep], doc[keep], first[keep], last[keep], low[keep], high[keep]


def fingerprints(w: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of the windows at ``starts``."""
    out = []
    for base, names in ((0xBF58476D1CE4E5B9, w.names), (0x94D049BB133111EB, mix(w.names + _STEP))):
        n = len(names)
        inverse = pow(base, -1, 1 << 64)
        power = np.cumprod(np.full(n, np.uint64(base)))
        back = np.cumprod(np.full(n, np.uint64(inverse)))
        sums = np.append(np.uint64(0), np.cumsum(names * power))
        out.append(mix((sums[starts + window] - sums[starts]) * back[starts]))
    return out[0], out[1]


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the names, so sorted names lie sorted by bucket."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(block: int, names: np.ndarray, more: np.ndarray | None, buckets: int, flag: int) -> list[tuple]:
    """Rows (bucket, block, flag, blob): sorted names, cut by bucket."""
    b = bucket_of(names, buckets)
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    ends = np.append(cuts[1:], len(b)) if len(b) else []
    return [(int(b[i]), block, flag, names[i:j].tobytes() + (b"" if more is None else more[i:j].tobytes())) for i, j in zip(cuts, ends)]


def distinct(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Sorted distinct entries, the entry of each row, and how often each occurs."""
    order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
    a2, b2 = a[order], None if b is None else b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a2[1:] != a2[:-1]) if b is None else (a2[1:] != a2[:-1]) | (b2[1:] != b2[:-1])
    at = np.cumsum(new) - 1
    back = np.empty(len(a), np.int64)
    back[order] = at
    return a2[new], None if b is None else b2[new], back, np.bincount(at, minlength=int(new.sum())) if len(a) else np.zeros(0, np.int64)


def marked(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Names whose last bit says that the block alone has it twice."""
    return (names & ~_ONE) | (counts > 1).astype(np.uint64)


_SENT = "bucket long, block long, flag int, blob binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("flag", pa.int32()), ("blob", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _SENT_ARROW)], schema=_SENT_ARROW)


def answer(rows: pa.Table) -> pa.Table:
    """For each packed blob of a bucket one bit an entry: whether it occurs twice. Flag 0
    holds names, 1 holds pairs of names, 2 goes back as it came."""
    buckets, blocks, flags, blobs = (rows.column(i).to_pylist() for i in range(4))
    out = []
    for flag, width in ((0, 8), (1, 16)):
        mine = [i for i, f in enumerate(flags) if f == flag]
        if not mine:
            continue
        sizes = [len(blobs[i]) // width for i in mine]
        a = np.concatenate([np.frombuffer(blobs[i], np.uint64, n) for i, n in zip(mine, sizes)])
        b = np.concatenate([np.frombuffer(blobs[i], np.uint64, n, 8 * n) for i, n in zip(mine, sizes)]) if width == 16 else None
        _, _, at, counts = distinct(a >> _ONE, b)
        twice = counts > 1
        twice[at[(a & _ONE) == _ONE]] = True
        bits, start = twice[at], 0
        for i, n in zip(mine, sizes):
            out.append((buckets[i], blocks[i], flag, np.packbits(bits[start : start + n]).tobytes()))
            start += n
    out += [(buckets[i], blocks[i], 2, blobs[i]) for i, f in enumerate(flags) if f == 2]
    return _table(out)


def bits_of(answers: pa.Table, names: np.ndarray, buckets: int) -> np.ndarray:
    """The answers to a block's sorted names."""
    by = {b: blob for b, f, blob in zip(*(answers.column(c).to_pylist() for c in ("bucket", "flag", "blob"))) if f != 2}
    b = bucket_of(names, buckets)
    counts = np.bincount(b, minlength=buckets) if len(b) else np.zeros(0, np.int64)
    parts = [np.unpackbits(np.frombuffer(by[i], np.uint8), count=int(counts[i])) for i in np.flatnonzero(counts)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, longest: int = LONGEST) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, removed, kept): the spans of removed words and the
    words kept, joined by one space."""
    longest = min(longest, max(1, window // 4))
    spark = docs.sparkSession
    n = docs.count()
    blocks, buckets = max(1, -(-n // BLOCK_DOCS)), max(1, -(-n // BUCKET_DOCS))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    # Named once here, so that the three readers share one exchange.
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    id_field = docs.schema["doc_id"]

    def reveal(rows: pa.Table) -> pa.Table:
        name, _, _ = symbols(Words(rows), rounds, longest)
        own, _, _, counts = distinct(name & ~_ONE)
        return _table(packed(rows.column("block")[0].as_py(), marked(own, counts), None, buckets, 0))

    def propose(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([])
        w, block = Words(rows), rows.column("block")[0].as_py()
        name, low, high = symbols(w, rounds, longest)
        own, _, at, _ = distinct(name & ~_ONE)
        once = ~bits_of(answers, own, buckets)[at]
        # Windows that hold everything that made a symbol which occurs once.
        start, end = np.maximum(high - window + 1, 0), low + 1
        some = once & (end > start) & (low >= 0)
        step = np.zeros(len(w.names) + 1, np.int64)
        np.add.at(step, start[some], 1)
        np.add.at(step, end[some], -1)
        open_ = w.windows(window) & (np.cumsum(step[:-1]) == 0)
        starts = np.flatnonzero(open_)
        if not len(starts):
            return _table([])
        a, b = fingerprints(w, starts, window)
        a, b, _, counts = distinct(a & ~_ONE, b)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]]))).astype(np.int64)
        return _table([*packed(block, marked(a, counts), b, buckets, 1), (block % buckets, block, 2, edge.tobytes())])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        w = Words(rows)
        gone = np.zeros(len(w.names), bool)
        edges = [np.frombuffer(blob, np.int64) for f, blob in zip(answers.column("flag").to_pylist(), answers.column("blob").to_pylist()) if f == 2]
        if edges:
            starts = np.concatenate([np.arange(i, j) for i, j in edges[0].reshape(-1, 2)])
            a, b = fingerprints(w, starts, window)
            own, _, at, _ = distinct(a & ~_ONE, b)
            hit = starts[bits_of(answers, own, buckets)[at]]
            step = np.zeros(len(gone) + 1, np.int64)
            step[hit] += 1
            np.add.at(step, hit + window, -1)
            gone = np.cumsum(step[:-1]) > 0
        n_removed, spans, kept = [], [], []
        for words, end in zip(w.words, w.ends.tolist()):
            mine = gone[end - len(words) : end]
            n_removed.append(int(mine.sum()))
            cut = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            spans.append([{"start": i, "end": j} for i, j in cut])
            kept.append(b" ".join([x for x, g in zip(words, mine.tolist()) if not g] if cut else words).decode("utf-8", "surrogatepass"))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table({
            "doc_id": w.ids, "n_words": pa.array(w.sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.string()),
        })

    sent = base.groupBy("block").applyInArrow(reveal, _SENT)
    told = sent.groupBy("bucket").applyInArrow(answer, _SENT)
    windows = base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(propose, _SENT)
    judged = windows.groupBy("bucket").applyInArrow(answer, _SENT)
    out = f"doc_id {id_field.dataType.simpleString()}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    return base.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(finish, out)

