"""Alignment of two tokenizers over whole texts by an associative monoid of fragments.

Both tokenizers (A, a byte-level BPE; B, pieces with a mark for the space) put a token boundary
before each space that follows a character other than white space, and what stands on either side
of such a *sure boundary* encodes alone as it does within the text: A splits there before merging,
and no piece of B holds a space after another character (checked when the vocabularies are read).
A text between two sure boundaries is therefore a closed run of groups.

Texts of more than ``LONG`` bytes are cut into byte ranges, spread over tasks. A range yields a
fragment: an open prefix up to its first sure boundary, closed groups, and an open suffix after its
last one. Fragments compose: the suffix of the left and the prefix of the right meet, and what is
now between sure boundaries closes. Composing is associative, so a tree of rounds (``FAN``
neighbours a round) reduces the fragments of a text; closed runs leave at once, and only open
ends travel. Tokens, groups and links are made of closed runs alone, in any task.

1. A first pass counts how many links of the corpus hold each pair of ids, summed up in the tasks
   before a shuffle that the vocabularies bound.
2. A second pass sums up the counts of each text's links. The pair table goes to the tasks if it has
   at most ``PAIRS`` rows; beyond that links meet it in a join.

A link is a pair of tokens whose bytes overlap, so a group of p and q tokens has p + q - 1.

Cases: null and empty texts have no tokens; so do texts that hold U+2581, as B's bytes then have a space
where the text has three bytes (all other characters come back, a test tries each). Strings of special
tokens are plain text. Repeated rows and ids are texts of their own; null ids are kept. A text without a
sure boundary is one run. An empty table gives no rows. Extra columns are ignored."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from menuloom.session import reliable_checkpoint

from .common import SLICE_ROWS, map_texts, utf8
from .token_counts import byte_letters

#: Bytes above which a text is cut, and bytes of a range.
LONG = 1 << 16
CHUNK = 1 << 15
#: Neighbouring fragments that one task composes in a round.
FAN = 32
#: Rows of the pair table that are sent to the tasks, at most.
PAIRS = 4_000_000
#: Runs remembered in a task.
REMEMBERED = 400_000
#: Runs that are spelt as one text.
_JOINED = 500
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SPACE = "▁"
_BREAK = re.compile(r"(?<=\S) ")
# A space at the start or after white space is no boundary; elsewhere every space is one.
_ODD = re.compile(r"(?:^|\s) ").search


def runs(text: str) -> list[str]:
    """Runs between sure boundaries, each without the space that it begins with."""
    return _BREAK.split(text) if _ODD(text) else text.split(" ")


class Vocabularies:
    """The contents of both vocabulary files; plain data that travels to the tasks."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            self.a = f.read()
        with open(path_b, "rb") as f:
            self.b = f.read()
        told = json.loads(self.a)
        pre = told.get("pre_tokenizer") or {}
        if told["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError(f"{path_a}: only byte-level BPE without normalizer or prefix space")
        if not all(t["special"] for t in told["added_tokens"]):
            raise ValueError(f"{path_a}: added tokens that are not special")
        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.b)
        inner = re.compile(f"[^{_SPACE}]{_SPACE}").search
        if any(inner(pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())):
            raise ValueError(f"{path_b}: a piece holds a space after another character")
        if sum(map(pieces.is_byte, range(pieces.get_piece_size()))) != 256:
            raise ValueError(f"{path_b}: no pieces for single bytes")
        if pieces.encode("a b") == pieces.encode("a  b") or pieces.encode("ﬁ") == pieces.encode("fi"):
            raise ValueError(f"{path_b}: it changes texts before it splits them")

    def plain(self) -> tuple[str, bytes]:
        return self.a, self.b


class Aligner:
    """Tokens, groups and links of runs; many runs are spelt as one text, and aligned by arrays."""

    def __init__(self, a: str, b: bytes, table: tuple[np.ndarray, ...] | None = None, remembered: int = REMEMBERED) -> None:
        """``table``: (codes in order, links, whether none of the same B id has more)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(a)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = {c: k for k, c in byte_letters().items()}
        entries = self.first.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte.get(c, 0) for c in entry)
        self.bytes_b = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.ids_a = len(self.bytes_a)
        self.written: list[str] = []
        self.table, self.remembered, self.known = table, remembered, {}
        self.sums, self.groups = np.zeros((0, len(SUMS)), np.int64), []

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.second.is_byte(i) else utf8(piece.replace(_SPACE, " "))

    def spell(self, keys: list[str]) -> tuple[np.ndarray, ...]:
        """Ids and ends of all tokens of both kinds, and the ends of the runs, as if the runs
        were one text. A run that ends in white space ends a text of its own."""
        ids, begin = ([], []), 0
        for at, key in enumerate(keys, 1):
            if not key or key[-1].isspace() or at - begin == _JOINED or at == len(keys):
                part, begin = keys[begin:at], at
                ids[0].append("".join([" " + k for k in part]))
                ids[1].append(" ".join(part))
        firsts = self.first.encode_batch_fast(ids[0], add_special_tokens=False)
        # The library gives no token for an empty text; here that is one space.
        seconds = [two or self.second.encode("a ")[-1:] for two in self.second.encode(ids[1], num_threads=1)]
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(map(len, x))) for x in ([one.ids for one in firsts], seconds))
        ends = np.cumsum(np.array([len(utf8(k)) + 1 for k in keys], np.int64))
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        if len(keys) and not end_a[-1] == end_b[-1] == ends[-1]:
            raise ValueError("tokens do not spell their text")
        return a, end_a, b, end_b, ends

    def links(self, spelt: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(code, run) of all links, by run."""
        a, end_a, b, end_b, ends = spelt
        start = end_a - self.sizes[0][a]
        low, high = np.searchsorted(end_b, start, "right"), np.searchsorted(end_b - self.sizes[1][b], end_a, "left")
        n = high - low
        one = np.repeat(np.arange(len(a)), n)
        two = np.arange(len(one)) + np.repeat(low - np.cumsum(n) + n, n)
        return b[two] * self.ids_a + a[one], np.searchsorted(ends, end_a[one])

    def write(self, spelt: tuple[np.ndarray, ...]) -> tuple[list[str], np.ndarray]:
        """The groups of each run as text, and (n_a, n_b, n_groups) of each run."""
        a, end_a, b, end_b, ends = spelt
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b, run = np.searchsorted(common, end_a), np.searchsorted(common, end_b), np.searchsorted(ends, common)
        last_a, last_b, last = (np.append(x[1:] != x[:-1], True) for x in (group_a, group_b, run))
        if not self.written:
            self.written = [f"{i}{mark}" for i in range(max(map(len, self.sizes))) for mark in ",|;\n"]
        out = np.empty(len(a) + len(b), np.int64)
        # A token stands behind all tokens of earlier groups; B's also behind A's of its own group.
        place = np.arange(len(common))
        out[np.arange(len(a)) + np.searchsorted(group_b, place)[group_a]] = a * 4 + last_a
        out[np.arange(len(b)) + np.searchsorted(group_a, place, "right")[group_b]] = b * 4 + np.where(last_b, 2 + last[group_b], 0)
        texts = "".join(map(self.written.__getitem__, out.tolist())).split("\n")[:-1]
        counts = [np.bincount(x, minlength=len(ends)) for x in (np.searchsorted(ends, end_a), np.searchsorted(ends, end_b), run)]
        return texts, np.stack(counts, axis=1)

    def learn(self, keys: list[str]) -> dict[str, int]:
        """The places of runs in ``sums`` (without a table the last two are 0) and ``groups``."""
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known, self.groups = {}, []
                new = list(dict.fromkeys(keys))
            first = len(self.known)
            if first + len(new) > len(self.sums):
                grown = np.zeros((max(first + len(new), min(2 * len(self.sums), self.remembered)), len(SUMS)), np.int64)
                grown[:first] = self.sums[:first]
                self.sums = grown
            sums = self.sums[first : first + len(new)]
            spelt = self.spell(new)
            texts, sums[:, :3] = self.write(spelt)
            code, run = self.links(spelt)
            sums[:, 3] = np.bincount(run, minlength=len(new))
            if self.table:
                codes, n, leads = self.table
                at, begins = np.searchsorted(codes, code), np.searchsorted(run, np.arange(len(new)))
                sums[:, 4], sums[:, 5] = (np.add.reduceat(x[at].astype(np.int64), begins) for x in (leads, n))
            self.groups += texts
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.known


# --- fragments of long texts ---------------------------------------------------

#: (start, prefix, closed, suffix, suffix_at): ``closed`` says whether a sure boundary was met. Without
#: one the whole text is the prefix. Offsets count characters of the document.
Fragment = tuple[int, str, bool, str, int]


def fragment(start: int, text: str) -> tuple[Fragment, list[tuple[int, str]]]:
    """The fragment of a range, and its closed run of groups as (offset, text)."""
    at = [m.start() for m in _BREAK.finditer(text)]
    if not at:
        return (start, text, False, "", start), []
    first, last = at[0], at[-1]
    closed = [(start + first + 1, text[first + 1 : last])] if last > first else []
    return (start, text[:first], True, text[last + 1 :], start + last + 1), closed


def compose(f: Fragment, g: Fragment) -> tuple[Fragment, list[tuple[int, str]]]:
    """Two neighbouring fragments as one, and what closed between them."""
    text, at = (f[3], f[4]) if f[2] else (f[1], f[0])
    text += g[1]
    if f[2] and g[2]:
        return (f[0], f[1], True, g[3], g[4]), [(at, text)]
    (_, head, met, tail, tail_at), closed = fragment(at, text)
    if not f[2] and not g[2]:
        return (at, head, met, tail, tail_at), closed
    if f[2]:
        if not met:
            return (f[0], f[1], True, text, at), []
        return (f[0], f[1], True, tail, tail_at), [(at, text[: tail_at - at - 1])]
    if not met:
        return (at, text, True, g[3], g[4]), []
    return (at, head, True, g[3], g[4]), [(at + len(head) + 1, text[len(head) + 1 :])]


_PARTS = pa.schema([
    ("row", pa.int64()), ("i", pa.int64()), ("start", pa.int64()), ("prefix", pa.string()), ("closed", pa.bool_()), ("suffix", pa.string()),
    ("suffix_at", pa.int64()), ("at", pa.int64()), ("text", pa.string()),
])
_PARTS_DDL = "row long, i long, start long, prefix string, closed boolean, suffix string, suffix_at long, at long, text string"


def _parts(fragments: list[tuple[int, int, Fragment]], closed: list[tuple[int, int, str]]) -> dict:
    rows = [(r, i, *f, None, None) for r, i, f in fragments] + [(r, *[None] * 6, at, text) for r, at, text in closed]
    return dict(zip(_PARTS.names, map(list, zip(*rows)), strict=True)) if rows else {n: [] for n in _PARTS.names}


def ranges(docs: DataFrame, chunk: int) -> DataFrame:
    """(row, doc_id, i, n, start, text): byte ranges of whole characters, fixed and spread over tasks."""
    out = pa.schema([("row", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("part", pa.string())])
    schema = docs.select("doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                cuts = []
                for c in range(0, len(raw), chunk):
                    while c < len(raw) and raw[c] & 0xC0 == 0x80:
                        c += 1
                    if c < len(raw) and (not cuts or c > cuts[-1]):
                        cuts.append(c)
                start = 0
                for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(raw)], strict=True)):
                    part = raw[a:b].decode("utf-8", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([v], t) for v, t in zip((row, i, len(cuts), start, part), out.types, strict=True))], ["doc_id", *out.names])
                    start += len(part)
                row += 1

    for name, kind in (("row", LongType()), ("i", LongType()), ("n", LongType()), ("start", LongType()), ("part", StringType())):
        schema = schema.add(name, kind)
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)
    return reliable_checkpoint(cut.repartition("row", "i"))


def closed_runs(parts: DataFrame, fan: int) -> DataFrame:
    """(row, at, text) of closed runs that together are the texts, by a tree of compositions."""
    most = parts.agg(F.max("n")).first()[0] or 0

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, i, start, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                f, closed = fragment(start, text)
                yield pa.RecordBatch.from_pydict(_parts([(row, i, f)], [(row, *c) for c in closed]), _PARTS)

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        row, place = key[0].as_py(), key[1].as_py()
        all_ = sorted((r["i"], (r["start"], r["prefix"], r["closed"], r["suffix"], r["suffix_at"])) for r in rows.to_pylist())
        whole, closed = all_[0][1], []
        for _, f in all_[1:]:
            whole, more = compose(whole, f)
            closed += more
        return pa.Table.from_pydict(_parts([(row, place, whole)], [(row, *c) for c in closed]), _PARTS)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text begins and ends with a sure boundary."""
        for batch in batches:
            out = []
            for row, start, prefix, met, suffix, at in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                out += [(row, start, prefix), (row, at, suffix)] if met else [(row, start, prefix)]
            yield pa.RecordBatch.from_pydict(_parts([], out), _PARTS)

    level = reliable_checkpoint(parts.select("row", "i", "start", "part").mapInArrow(begin, _PARTS_DDL))
    done = [level.where("text IS NOT NULL")]
    while most > 1:
        place = F.expr(f"i div {fan}").alias("place")
        # A row stands for a document's next FAN fragments; open ends are all that moves.
        level = reliable_checkpoint(level.where("text IS NULL").groupBy("row", place).applyInArrow(join, _PARTS_DDL))
        done.append(level.where("text IS NOT NULL"))
        most = -(-most // fan)
    done.append(level.where("text IS NULL").select("row", "start", "prefix", "closed", "suffix", "suffix_at").mapInArrow(end, _PARTS_DDL))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("row", "at", "text")


# --- passes --------------------------------------------------------------------


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes as one."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], np.add.reduceat(n, first) if len(n) else n


def pair_counts(texts: DataFrame, make: Callable[[], Aligner]) -> DataFrame:
    """(code, n): links by pair of ids over the runs of texts, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = make(), Counter()

        def flush() -> pa.RecordBatch:
            keys, found = list(counts), []
            for start in range(0, len(keys), 50_000):
                part = keys[start : start + 50_000]
                code, run = aligner.links(aligner.spell(part))
                found.append(_added(code, np.array([counts[k] for k in part])[run]))
            counts.clear()
            code, n = _added(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                    counts.update(runs(text))
                if len(counts) > REMEMBERED:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _sums(make: Callable[[], Aligner], whole: bool) -> Callable[[], Callable[[list], list]]:
    """A function of texts for ``map_texts``: the sums, and the groups as text (``whole``: their
    digest, and nothing for a text without tokens)."""

    def start() -> Callable[[list], list]:
        aligner = make()

        def work(texts: list) -> list:
            cut = [None if whole and (not t or _SPACE in t) else runs(t) for t in texts]
            known = aligner.learn([k for keys in cut if keys for k in keys])
            sums, groups = np.zeros((len(texts), len(SUMS)), np.int64), []
            for i, keys in enumerate(cut):
                if keys is None:
                    groups.append("")
                    continue
                at = [known[k] for k in keys]
                sums[i] = aligner.sums[at].sum(axis=0)
                text = ";".join([aligner.groups[j] for j in at])
                groups.append(hashlib.sha256(text.encode()).hexdigest() if whole else text)
            return [*sums.T.tolist(), groups]

        return work

    return start


def _links(texts: DataFrame, make: Callable[[], Aligner]) -> DataFrame:
    """(row, code, m): how many links of a text hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = make()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = Counter(runs(text))
                code, at = aligner.links(aligner.spell(list(keys)))
                code, m = _added(code, np.array(list(keys.values()))[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code), pa.array(m)], ["row", "code", "m"])

    return texts.select("row", "text").mapInArrow(run, "row long, code long, m long")


def align(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", long: int = LONG, chunk: int = CHUNK, fan: int = FAN, pairs: int = PAIRS,
) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per text."""
    spark = docs.sparkSession
    files = Vocabularies(path_a, path_b).plain()
    ids_a = Aligner(*files).ids_a
    sent = spark.sparkContext.broadcast(files)
    plain = lambda: Aligner(*sent.value)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spoken = F.coalesce((F.col("text") != "") & ~F.col("text").contains(_SPACE), F.lit(False))
    far = spoken & (F.octet_length("text") > long)
    short = source.where(~far)
    parts = ranges(source.where(far), chunk)
    closed = reliable_checkpoint(closed_runs(parts, fan))
    names = parts.where("i = 0").select("row", "doc_id")

    counts = pair_counts(short.where(spoken).select("text").union(closed.select("text")), plain)
    of_b = Window.partitionBy(F.expr(f"code div {ids_a}"))
    table = reliable_checkpoint(counts.select("code", "n", (F.col("n") == F.max("n").over(of_b)).alias("leads")))
    joined = table.count() > pairs
    make = plain
    if joined:
        short = reliable_checkpoint(short.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    else:
        got = table.toArrow()
        code = got.column("code").to_numpy()
        order = np.argsort(code)
        lookup = spark.sparkContext.broadcast((code[order], got.column("n").to_numpy()[order], got.column("leads").to_numpy()[order]))
        make = lambda: Aligner(*sent.value, lookup.value)

    fields = [StructField(c, LongType()) for c in SUMS]
    near = map_texts(short, [c for c in ("row", "doc_id") if c in short.columns], [*fields, StructField("groups_sha256", StringType())], _sums(make, True))
    pieces = map_texts(closed, ["row", "at"], [*fields, StructField("groups", StringType())], _sums(make, False))
    inner = F.array_sort(F.collect_list(F.struct("at", "groups")))
    digest = F.sha2(F.array_join(F.transform(inner, lambda x: x["groups"]), ";").cast("binary"), 256)
    rest = pieces.groupBy("row").agg(*(F.sum(c).alias(c) for c in SUMS), digest.alias("groups_sha256")).join(names, "row")
    out = []
    for rows, texts in ((near, short.where(spoken)), (rest, closed)):
        if joined:
            met = _links(texts, plain).join(table, "code").groupBy("row")
            met = met.agg(F.sum(F.col("m") * F.col("n")).alias("s"), F.sum(F.when(F.col("leads"), F.col("m")).otherwise(0)).alias("l"))
            rows = rows.join(met, "row", "left").withColumn("n_best", F.coalesce("l", F.lit(0)).cast("long")).withColumn("count_sum", F.coalesce("s", F.lit(0)).cast("long"))
        out.append(rows.select("doc_id", *SUMS, "groups_sha256"))
    return out[0].union(out[1])
