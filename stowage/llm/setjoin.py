"""Exact n-gram Jaccard join that skips work through relations between sets.

Equal sets are one class. Each class is compared with the hub of its min-hash bucket first; a class that
links with its hub derives its answers from the hub's: it posts only the prefix shingles that the hub does not
post, and whatever the hub finds is checked against it only if the two sets' difference leaves room for a link.
Prefixes are cut from the rare end of an order by frequency (a sketch of all documents' shingles, summed by range and sent
back to each unit of documents), so few unlike sets share a posted shingle. A list entry holds the shingle's place in its
set; lists are in order of size and place, in blocks that know their bounds, and whole blocks are skipped where what can lie
before and behind the shingle leaves no room for a link. Frequencies and blocks change the work only, never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .components import components
from .shared import drop_written, freed, tasks_for, written
from .units import Cells, answers_of, in_units, opened, ranges_for, sketched

HOT = 24  # documents from which a shingle's list is read by place only, see list_pairs()
BLOCK = 64  # entries of a block of a list
MINS = 4  # min-hashes of a set
PAIRS = 200_000  # pairs that are looked at together


class Sets:
    """The shingle sets of a block's documents: sorted distinct values, set d at bounds[d]..bounds[d + 1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, size: int):
        raw = scan.LOWER[raw]
        words = scan.Words(raw, offsets)
        h = scan.span_hash(raw, words.start, words.end)
        n_words = np.diff(words.first)
        at = scan.window_starts(words.first, size)
        values, doc = [scan.window_hash(h, size)[at]] if len(at) else [], [words.doc[at]]
        for k in range(1, size):
            short = np.flatnonzero(n_words == k)
            if len(short):
                values.append(scan.mix(scan.window_hash(h, k)[words.first[short]] + np.uint64(k)))
                doc.append(short)
        n = len(offsets) - 1
        values, doc = np.concatenate(values) if values else np.zeros(0, scan.U), np.concatenate(doc)
        order = scan.order_by(values, doc)
        values, doc = values[order], doc[order]
        keep = np.append(True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1]))[: len(values)]
        self.values, self.doc = values[keep], doc[keep]
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        self.n = np.diff(self.bounds)

    def fold(self, values: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
        out = np.full(len(self.n), empty, scan.U)
        some = self.n > 0
        if some.any():
            out[some] = how.reduceat(values, self.bounds[:-1][some])
        return out

    def names(self) -> list[bytes]:
        """16 bytes that name a set by its content."""
        x, y = self.fold(scan.mix(self.values ^ np.uint64(0xA5A5)), np.add, 0), self.fold(scan.mix(self.values + np.uint64(0x1F35)), np.add, 0)
        flat = np.stack([x, y ^ self.n.astype(scan.U)], 1).astype(">u8").tobytes()
        return [flat[i : i + 16] for i in range(0, len(flat), 16)]


def describe(units: DataFrame, size: int) -> DataFrame:
    """Per document its unit and place there, its set's name, size and min-hashes."""
    names = ["unit", "at", "doc_id", "n", "cid", *(f"m{i}" for i in range(MINS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column("unit").to_pylist(), batch.column("data"), strict=True):
                at = 0
                for rows, raw, offsets in scan.blocks(opened(data), "text"):
                    s = Sets(raw, offsets, size)
                    mins = [s.fold(scan.mix(s.values ^ scan.BYTE_VALUE[1][salt]), np.minimum, 0).view(np.int64) for salt in range(MINS)]
                    place = [pa.array(np.full(len(rows), unit, np.int64)), pa.array(np.arange(at, at + len(rows), dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays([*place, rows.column("doc_id"), pa.array(s.n.astype(np.int64)), pa.array(s.names(), pa.binary()), *map(pa.array, mins)], names)
                    at += len(rows)

    return units.select("unit", "data").mapInArrow(freed(run), "unit long, at int, doc_id long, n long, cid binary" + "".join(f", m{i} long" for i in range(MINS)))


def unit_sets(rows: pa.RecordBatch, size: int) -> Sets:
    """The sets of a whole unit, made a block at a time: what it takes to make them is several times the text."""
    parts = [Sets(raw, offsets, size) for _, raw, offsets in scan.blocks(rows, "text")]
    if len(parts) == 1:
        return parts[0]
    out = Sets.__new__(Sets)
    out.n = np.concatenate([np.zeros(0, np.int64), *(s.n for s in parts)])
    out.values = np.concatenate([np.zeros(0, scan.U), *(s.values for s in parts)])
    out.doc, out.bounds = np.repeat(np.arange(len(out.n)), out.n), np.append(0, np.cumsum(out.n))
    return out


def level(count: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling of a count."""
    return np.minimum(8 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def prefixes(units: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """id, prefix and n_cold: the rarest shingles of every class, rarest first, and how many of them are not HOT."""
    ranges = ranges_for(units)
    answers = written(sketched(units, lambda rows: [unit_sets(rows, size).values], ranges, level), "levels")
    wanted = classes.groupBy("unit").agg(F.collect_list(F.struct("at", "id")).alias("wanted"))
    hot = level(np.array([HOT]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers, wanted in zip(batch.column("data"), batch.column("answers").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                s = unit_sets(opened(data), size)
                levels = Cells(s.values, ranges).back(answers_of(answers, 0))
                order = np.argsort(levels, kind="stable")  # by value within a level
                order = order[scan.order_by(None, s.doc[order])]
                ordered, cold = s.values[order], levels[order] < hot
                length = s.n - -(-num * s.n // den) + 1
                for i in range(0, len(wanted), 2000):
                    ids, parts, n_cold = [], [], []
                    for x in wanted[i : i + 2000]:
                        at = slice(s.bounds[x["at"]], s.bounds[x["at"]] + length[x["at"]])
                        ids.append(x["id"])
                        parts.append(ordered[at].tobytes())
                        n_cold.append(int(np.count_nonzero(cold[at])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary()), pa.array(n_cold, pa.int64())], ["id", "prefix", "n_cold"])

    return units.select("unit", "data").join(wanted, "unit").join(answers, "unit", "left").select("data", "answers", "wanted").mapInArrow(freed(run), "id long, prefix binary, n_cold long")


def sets_of(units: DataFrame, classes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, n and set of the classes whose id is among `ids`, taken from one document each."""
    wanted = ids.distinct().join(classes, "id").groupBy("unit").agg(F.collect_list(F.struct("at", "id")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column("data"), batch.column("wanted").to_pylist(), strict=True):
                s = unit_sets(opened(data).take(pa.array([x["at"] for x in wanted])), size)
                for i in range(0, len(wanted), 2000):
                    j = range(i, min(i + 2000, len(wanted)))
                    sets = [s.values[s.bounds[d] : s.bounds[d + 1]].tobytes() for d in j]
                    yield pa.RecordBatch.from_arrays([pa.array([wanted[d]["id"] for d in j], pa.int64()), pa.array(s.n[j.start : j.stop].astype(np.int64)), pa.array(sets, pa.binary())], ["id", "n", "set"])

    return written(units.select("unit", "data").join(wanted, "unit").select("data", "wanted").mapInArrow(freed(run), "id long, n long, set binary"), "chosen")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb and overlap of the pairs; a set of very many partners is split over tasks by the adaptive join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("set_a"), batch.column("set_b")
            out = np.zeros(len(batch), np.int64)
            last, held = None, None
            for i in range(len(batch)):
                u, v = x[i].as_buffer(), y[i].as_buffer()
                if last is None or not u.equals(last):
                    last, held = u, np.frombuffer(u, np.uint64)
                v = np.frombuffer(v, np.uint64)
                at = np.minimum(np.searchsorted(held, v), len(held) - 1)
                out[i] = (held[at] == v).sum()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out)], ["a", "b", "na", "nb", "overlap"])

    one = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("set_b"))
    two = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("set_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "na", "nb", "set_a", "set_b").mapInArrow(freed(run), "a long, b long, na long, nb long, overlap long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, gain, token: what b has and a has not (gain), and the reverse; gained and lost are how many of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("set_a", "set_b"))
                gained, lost = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                n = len(gained) + len(lost)
                fill = lambda v, t, n=n: pa.array(np.full(n, v), t)
                yield pa.RecordBatch.from_arrays([fill(batch.column("a")[i].as_py(), pa.int64()), fill(batch.column("b")[i].as_py(), pa.int64()), pa.array(np.arange(n) < len(gained)), pa.array(np.concatenate([gained, lost])), fill(len(gained), pa.int64()), fill(len(lost), pa.int64())], ["a", "b", "gain", "token", "gained", "lost"])

    one, two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b").mapInArrow(freed(run), "a long, b long, gain boolean, token long, gained long, lost long")


PAIR = ("n", "lo", "slack", "n_hot")
ENTRY = ("n", "lo", "hi", "pos", "most", "slack", "n_hot")


def expanded(n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, 0), (k, 1) ... (k, n[k] - 1) for every k, in parts of about `most` pairs."""
    total = np.append(0, np.cumsum(n))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        k = np.repeat(np.arange(at, to), n[at:to])
        yield k, np.arange(len(k)) - (total[k] - total[at])
        at = to


class Lists:
    """Whole lists, by token; within a list by size and place, in blocks of BLOCK entries with their bounds."""

    def __init__(self, rows: pa.RecordBatch, num: int, den: int):
        self.num, self.den = num, den
        self.token, self.id, self.root = (rows.column(c).to_numpy() for c in ("token", "id", "root"))
        self.n, self.lo, self.hi, self.pos, self.most, self.slack, self.n_hot = (rows.column(c).to_numpy().astype(np.int64) for c in ENTRY)
        self.hot = rows.column("hot").to_numpy(zero_copy_only=False)
        self.rest = self.n - self.pos - 1
        total = len(self.token)
        start = np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1]))
        size = np.diff(np.append(start, total))
        blocks = -(-size // BLOCK)
        of = np.repeat(np.arange(len(start)), blocks)
        self.block_start = start[of] + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        self.block_end = np.append(self.block_start[1:], total)
        self.own = np.repeat(np.arange(len(of)), self.block_end - self.block_start)
        self.last_block = np.cumsum(blocks)[of][self.own]
        least, greatest = (lambda x, f=f: f.reduceat(x, self.block_start) for f in (np.minimum, np.maximum))
        self.b_lo, self.b_hi, self.b_root = least(self.lo), greatest(self.hi), (least(self.root), greatest(self.root))
        self.b_pos, self.b_rest, self.b_most, self.b_slack = (greatest(x) for x in (self.pos, self.rest, self.most, self.slack))

    def room(self, k: np.ndarray, lo, hi, pos, rest, most, slack) -> np.ndarray:
        """Whether entry k and one with these numbers may link.

        A shingle at two places has at most the lesser number before it and behind it in common. If a hot one is the first that
        two sets share, nothing is before it but what they don't post; if it isn't, they have met at the first.
        """
        before = np.where(self.hot[k], self.slack[k] + slack, np.minimum(self.pos[k], pos) + self.most[k] + most)
        fits = (self.den + self.num) * (before + 1 + np.minimum(self.rest[k], rest)) >= self.num * (self.lo[k] + lo)
        return fits & (self.den * self.hi[k] >= self.num * lo) & (self.den * hi >= self.num * self.lo[k])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, d in expanded(self.last_block - self.own, PAIRS):
            b = self.own[k] + d
            ok = (self.block_end[b] > k + 1) & ~((self.b_root[0][b] == self.root[k]) & (self.b_root[1][b] == self.root[k]))
            k, b = k[ok], b[ok]
            ok = self.room(k, self.b_lo[b], self.b_hi[b], self.b_pos[b], self.b_rest[b], self.b_most[b], self.b_slack[b])
            k, b = k[ok], b[ok]
            begin = np.maximum(k + 1, self.block_start[b])
            for i, d in expanded(self.block_end[b] - begin, PAIRS):
                x, y = k[i], begin[i] + d
                ok = self.root[x] != self.root[y]
                x, y = x[ok], y[ok]
                ok = self.room(x, self.lo[y], self.hi[y], self.pos[y], self.rest[y], self.most[y], self.slack[y])
                if ok.any():
                    yield x[ok], y[ok]


def list_pairs(entries: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Candidate pairs (a, b) of entries that share posted shingles, hang below different roots, and may link.

    Shingles of HOT documents or more pair only where they can be the first that two sets share; the others, whose lists are
    short, wherever their places leave room. A pair stays if the shingles found leave room: beyond the prefix that ends first
    only num/den of that set (less one) can be shared, and of hot ones no more than either posts. `slack` is what an entry does not post and
    what the classes below it (`most` at most) have beyond it.
    """
    columns = ["a", "b", "shared", *(f"{c}_{s}" for s in "ab" for c in PAIR)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = Lists(rows, num, den)
            found, n = [], 0
            for x, y in lists.pairs():
                found.append((x, y))
                n += len(x)
                if n >= PAIRS:
                    yield made(lists, found)
                    found, n = [], 0
            if n:
                yield made(lists, found)

        def made(lists: Lists, found: list) -> pa.RecordBatch:
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            ids = lists.id
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            order = np.lexsort((ids[y], ids[x]))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.append(True, (ids[x][1:] != ids[x][:-1]) | (ids[y][1:] != ids[y][:-1])))
            shared = np.add.reduceat((~lists.hot[x]).astype(np.int32), first).astype(np.int32)
            x, y = x[first], y[first]
            info = [pa.array(getattr(lists, c)[at].astype(np.int32)) for at in (x, y) for c in PAIR]
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(shared), *info], columns)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            token = batch.column("token").to_numpy()
            if not len(token):
                continue
            if n >= 50_000 and held[0].column("token")[0].as_py() != token[-1]:
                last = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next batch
                held.append(batch.slice(0, last))
                yield from pairs(held)
                held, n, batch = [], 0, batch.slice(last)
            held.append(batch)
            n += len(batch)
        if held:
            yield from pairs(held)

    size = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)) if num < den else F.col("n")
    rows = entries.repartition(parts, "token").sortWithinPartitions("token", size, "pos")
    rows = rows.mapInArrow(freed(run), ", ".join(f"{c} {'long' if c in 'ab' else 'int'}" for c in columns))
    pairs = rows.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *(F.first(c).alias(c) for c in columns[3:]))
    beyond = f"greatest(ceil({num} * n_a / {den}), ceil({num} * n_b / {den})) - 1"
    return pairs.where(f"{den + num} * (shared + least(n_hot_a, n_hot_b) + {beyond} + slack_a + slack_b) >= {num} * (lo_a + lo_b)").select("a", "b")


def entries_of(posted: DataFrame) -> DataFrame:
    """A row per posted shingle: those of the prefix that the hub does not post."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                rows = batch.slice(i, 500)
                own, places, slack, hot = [], [], [], []
                for p, q, most, n_cold in zip(*(rows.column(c).to_pylist() for c in ("prefix", "hub_prefix", "most", "n_cold")), strict=True):
                    p = np.frombuffer(p, np.int64)
                    at = np.arange(len(p)) if q is None else np.flatnonzero(~np.isin(p, np.frombuffer(q, np.int64)))
                    own.append(p[at])
                    places.append(at)
                    slack.append(most + len(p) - len(at))
                    hot.append(int((at >= n_cold).sum()))
                n = np.repeat(np.arange(len(rows)), [len(p) for p in own])
                place = np.concatenate(places)
                numbers = {c: rows.column(c).to_numpy()[n] for c in ("n", "lo", "hi", "most")} | {"pos": place, "slack": np.array(slack)[n], "n_hot": np.array(hot)[n]}
                small = [pa.array(numbers[c].astype(np.int32)) for c in ENTRY]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), rows.column("id").take(pa.array(n)), rows.column("root").take(pa.array(n)), *small, pa.array(place >= rows.column("n_cold").to_numpy()[n])], ["token", "id", "root", *ENTRY, "hot"])

    return posted.select("prefix", "hub_prefix", "n_cold", "id", "root", "n", "lo", "hi", "most").mapInArrow(freed(run), "token long, id long, root long, " + "".join(f"{c} int, " for c in ENTRY) + "hot boolean")


def near_duplicates(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and group_id: per row of `docs`, in no order.

    Shingles are `size` words, A-Z lower-cased; a text of fewer words is one shingle; a text without words (or null) has
    the empty set, n_shingles 0, and is a component of its own. Sets link when den * |x & y| >= num * |x | y|;
    component_id is the least doc_id that links lead to. Rows that share a doc_id and equal texts are
    members like any other; a null doc_id never is the least unless no other is there. group_id numbers the groups (null: none).
    """
    return grouped(in_units(docs, "doc_id"), size, num, den).drop("unit", "at")


def grouped(units: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """unit, at, doc_id, n_shingles, component_id and group_id of near_duplicates(), for documents in units."""
    parts = tasks_for(units, 4)
    table = written(describe(units, size), "sets")
    classes = table.where("n > 0").groupBy("cid").agg(*(F.first(c).alias(c) for c in ("n", *(f"m{i}" for i in range(MINS)))), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("unit", "at")).alias("place"))
    classes = written(classes.select("*", "place.*").drop("place").withColumn("id", F.monotonically_increasing_id()), "classes")  # written with their numbers, so these stay

    def both_sets(pairs: DataFrame) -> DataFrame:
        return sets_of(units, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")), size)

    # Relations: each class and the hub (the one with most copies) of its min-hash buckets, where the sizes can link.
    is_link = f"{den + num} * overlap >= {num} * (na + nb)"
    can_link = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    one = F.col("id").alias("b"), F.col("n").alias("nb")
    minima = [f"m{i}" for i in range(MINS)]
    hubs = {m: classes.groupBy(m).agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("na")), F.struct("copies", -F.col("id"))).alias("hub"), F.count("*").alias("k")).where("k > 1").select(m, "hub.*") for m in minima}
    stars = {m: classes.join(hub, m).select("a", "na", *one).where(f"a <> b and {can_link}").select("a", "b") for m, hub in hubs.items()}
    all_stars = written(stars["m0"].withColumn("first", F.lit(True)).union(stars["m1"].withColumn("first", F.lit(False))).groupBy("a", "b").agg(F.max("first").alias("first")), "stars")
    sets = both_sets(all_stars)
    near_hub = written(verified(all_stars.select("a", "b"), sets).join(all_stars, ["a", "b"]), "near_hub")
    # A hub chosen blindly may stand at the edge of its group; what is most like it stands nearer to the middle.
    middle = near_hub.where("first").groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("c"), F.col("nb").alias("nc")), F.struct(F.col("overlap") / (F.col("na") + F.col("nb")), -F.col("b"))).alias("m")).select("a", "m.*")
    again = near_hub.where(f"first and not ({is_link})").join(middle, "a").where(f"b <> c and {den} * least(nb, nc) >= {num} * greatest(nb, nc)").select(F.col("c").alias("a"), "b")
    near_middle = written(verified(again, sets), "near_middle")
    linked = written(near_hub.where(is_link).select("a", "b", "na", "nb", "overlap", "first").unionByName(near_middle.where(is_link).withColumn("first", F.lit(True))), "linked")
    drop_written(sets)
    # The hubs of the other minima bring together what these have left apart.
    root = components(linked).select(F.col("node").alias("id"), "root")
    for m in minima[2:]:
        apart = stars[m].join(root.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left").join(root.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")
        apart = written(apart.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "apart")
        more = written(verified(apart, both_sets(apart)).where(is_link).select("a", "b", "na", "nb", "overlap").withColumn("first", F.lit(False)), "more")
        linked = linked.unionByName(more)
        root = components(linked).select(F.col("node").alias("id"), "root")
    # One hub per class: its bucket's hub if they link, else the bucket's middle. What a class has beyond its hub adds up along the way.
    tree = linked.where("first").groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct(F.col("a").alias("hub"), (F.col("nb") - F.col("overlap")).alias("more")), "a").alias("h")).select("id", "h.*")
    tree = written(tree, "tree")
    below = written(descendants(tree, classes.select("id", "n")), "below")  # hub, id, n, more: every class under each hub
    span = below.groupBy(F.col("hub").alias("id")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("more").alias("most"))
    info = tree.select("id", "hub").join(root, "id", "full").join(span, "id", "full")
    first = written(prefixes(units, classes, size, num, den), "prefixes")
    posting = first.select(F.col("id").alias("hub"), F.col("prefix").alias("hub_prefix"))
    posted = first.join(classes.select("id", "n"), "id").join(info, "id", "left").select("id", "n", "n_cold", "prefix", "hub", F.coalesce("root", "id").alias("root"), F.least("n", "lo").alias("lo"), F.greatest("n", "hi").alias("hi"), F.coalesce("most", F.lit(0)).alias("most"))
    members = posted.where("hub is not null").join(posting, "hub")
    posted = posted.where("hub is null").withColumn("hub_prefix", F.lit(None).cast("binary")).unionByName(members)
    pairs = written(list_pairs(entries_of(posted), num, den, parts), "pairs")
    drop_written(first)
    more_sets = both_sets(pairs)
    checked = written(verified(pairs, more_sets), "checked")
    drop_written(more_sets)
    links = linked.select("a", "b").union(checked.where(is_link).select("a", "b"))

    # A hub's answers serve the classes y below it: z links with y, not with the hub h, only if z shares with y something
    # that h has not, or (y having lost more than it gained) lacks with y something that h has.
    reach = span.select(F.col("id").alias("a"), F.col("lo").alias("lo_a"), F.col("most").alias("most_a"))

    def hub_misses(rows: DataFrame) -> DataFrame:
        """Both ways round, those whose a has classes below it."""
        both = rows.select("a", "b", "na", "nb", "overlap").unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "overlap"))
        return both.join(reach, "a")


    misses = checked.where(f"not ({is_link})")
    lower = below.select(F.col("hub").alias("b"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("more").alias("more_y"))
    wide = hub_misses(misses).join(lower, "b").where(f"{den + num} * (overlap + most_a + more_y) >= {num} * (lo_a + ny)").select("a", F.col("y").alias("b"))
    wide = written(wide.distinct(), "wide")
    if not wide.isEmpty():
        wide_sets = both_sets(wide)
        seen = written(verified(wide, wide_sets), "seen")
        drop_written(wide_sets)
        links = links.union(seen.where(is_link).select("a", "b"))
        misses = misses.unionByName(seen.where(f"not ({is_link})"))
    near = written(hub_misses(misses).where(f"{den + num} * (overlap + most_a) >= {num} * (lo_a + nb)").select("a", "b").distinct(), "near")
    if not near.isEmpty():
        own = below.join(near.select(F.col("a").alias("hub")).distinct(), "hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        these = both_sets(near.union(own))
        left, right = differences(near, these), differences(own, these).where("gain or lost > gained")
        derived = left.select("a", "gain", "token", "b").join(right.select("a", "gain", "token", F.col("b").alias("y")), ["a", "gain", "token"]).where("b <> y")
        derived = written(derived.select(F.least("b", "y").alias("a"), F.greatest("b", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "derived")
        links = links.union(verified(derived, these).where(is_link).select("a", "b"))
    roots = components(links)
    label = classes.select("cid", "id", "least").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    label = label.join(label.groupBy("root").agg(F.min("least").alias("component")), "root").select("cid", "component", "root")
    out = table.join(label, "cid", "left")
    return out.select("unit", "at", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.col("root").alias("group_id"))


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group, the row with the smallest doc_id (null last) and place stays.

    Texts without words are in no group and all stay.
    """
    names = docs.columns
    units = in_units(docs, *(c for c in names if c != "text"))
    groups = grouped(units, size, num, den)
    stay = groups.where("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit", "at")).alias("p")).select("p.unit", "p.at")
    stay = stay.unionByName(groups.where("n_shingles = 0").select("unit", "at")).groupBy("unit").agg(F.collect_list("at").alias("stay"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, stay in zip(batch.column("data"), batch.column("stay").to_pylist(), strict=True):
                yield opened(data).select(names).take(pa.array(sorted(stay)))

    return units.join(stay, "unit").select("data", "stay").mapInArrow(freed(run), docs.schema)


def descendants(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """hub, id, n, more for every class below each hub at any depth (two min-hashes: chains are short)."""
    step = written(tree.select("hub", "id", "more"), "step")
    out = step
    while True:
        up = tree.select(F.col("id").alias("hub"), F.col("hub").alias("upper"), F.col("more").alias("extra"))
        step = written(step.join(up, "hub").select(F.col("upper").alias("hub"), "id", (F.col("more") + F.col("extra")).alias("more")), "step")
        if step.isEmpty():
            return out.join(sizes, "id").select("hub", "id", "n", "more")
        out = out.union(step)
