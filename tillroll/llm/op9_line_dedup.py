"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  A line of at least ``min_words`` words is removed if an earlier one
(by document id, then by place) has a Jaccard similarity of at least ``PERCENT``/100.  The query and
the pipeline ask for 1, every line that has a word; the default of ``MIN_WORDS`` leaves shorter lines
alone.

Sets of so few words that only an equal one is similar (up to 3 words at 80 percent; one of 4 and one
of 5 can be) are known by a hash of the whole set: their first place is a minimum by that hash, and
they take no part in the join of the other lines:

1. Word frequencies of all documents are counted in ``1 << FREQUENCY_BITS`` hash cells, a table of
   fixed size that every task gets.  Words are ordered by the frequency of their cell, then by hash:
   any fixed order keeps the join exact, and this one puts rare words first.  A cell that counts one
   occurrence holds no word that two lines share.
2. Prefix filter: two similar lines share a word among the first ``n - ceil(t n) + 1`` of each.  Each
   task deals these postings to buckets by word, equal lines once, from their first place, with length,
   position and a 128-bit parity of the line's words: lines of different parity in b bits differ in b
   words at least.  It passes on the first place of each line by a hash of the line; the others repeat it.
3. In the list of a word, each line is paired with the earlier lines that the length, positional and
   parity filters allow.  One earlier similar line suffices, so a line gets its ``NEAREST`` of them
   by parity; a line that had more is noted.  Each list has a line's first place, as the task that met
   it passed on all the line's postings; so the list tells which line of a pair is the earlier.
4. Pairs are verified against full word sets, stored once for both searches.  Noted lines of which no
   pair held are searched again, without that limit, among the postings that they were allowed to pair
   with, which the first search kept, and in the lists of frequent words; so nothing is lost.  Texts are
   read for it again only for lines of such lists whose sets were not stored.

A word that is frequent within a task leaves one representative in the shuffle and its lines as
rows; its list is searched chunk against chunk (``CHUNK`` lines each), so no such list is gathered
in one task.

Defined cases: null and empty texts, and lines without words, are not removed; equal lines in one document are
repeats too; rows that repeat an id count as one document; a null id ranks last; an empty table
gives an empty result; other columns are kept by ``dedup`` and not read otherwise.  Identifiers must
be integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import blobs as B, texthash as H
from tillroll.llm.scratch import store, tasks

PERCENT, MIN_WORDS, NEAREST = 80, 5, 2
FREQUENCY_BITS, FREQUENCY_PARTS = 20, 64
FLUSH, FREQUENT, CHUNK, SEEN = 1 << 20, 256, 2048, 1 << 19
#: Candidate pairs that a task looks at in one go.
SLAB = 1 << 17
LAST = np.iinfo(np.int64).max
FIRSTS, POSTINGS, LEADERS, PAIRS, MEMBERS, NOTED, NEAR, GONE, TEXTS = range(9)
OUT = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "kind tinyint, bucket int, blob binary"
POSTING = ["u6", "<u8", "<i8", "<u4", "<u2", "<u2", "<u8", "<u8"]
WORD, LINE, DOC, NUMBER, SIZE, PLACE, PARITY, PARITY_UP = range(8)
#: A place of a line: its hash, document, whether that has an id, and number.
AT = ["<u8", "<i8", "u1", "<u4"]
#: A size or place of this many words or more is only known to be so.
MOST = (1 << 16) - 1


def frequencies(source: DataFrame) -> np.ndarray:
    """Occurrences of words by hash cell, over all documents."""
    cells = 1 << FREQUENCY_BITS
    each = cells // FREQUENCY_PARTS

    def emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(FREQUENCY_PARTS):
            yield pa.record_batch({"part": pa.array([i], pa.int32()), "counts": pa.array([total[i * each:(i + 1) * each].astype("<i8").tobytes()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for chunk in H.chunks(batch.column("text")):
                found = H.words(chunk.data, chunk.offsets[:-1], rows=False).hash
                np.add.at(total, (found & H.U(cells - 1)).astype(np.int64), 1)
        if total.any():
            yield from emit(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), "<i8")
        for part, total in sums.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    counted = source.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(cells, np.int64)
    for row in counted.collect():  # one row a part
        out[row.part * each:(row.part + 1) * each] = np.frombuffer(row.counts, "<i8")
    return out


def ordered(frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of each cell, rarest first, and how many cells count one occurrence at most."""
    place = np.empty(len(frequency), "<u4")
    place[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency), dtype="<u4")
    return place, int((frequency <= 1).sum())


class Lines:
    """The lines of a chunk of at least ``least`` distinct words: keys of each, rarest first.

    A line is known by a hash of its bytes, which needs no words: with a filter ``wanted``, words are
    taken of the lines that it lets through alone.  A line of at most ``alike`` words is known by a hash
    of its set.
    """

    def __init__(self, chunk: H.Chunk, order: tuple[np.ndarray, int], least: int, alike: int, wanted: np.ndarray | None = None) -> None:
        place, single = order
        data = chunk.data
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.concatenate([chunk.offsets[:-1], breaks])
        starts.sort()
        starts = starts[starts < len(data)]
        if len(starts):
            starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])]
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        body = ends - (data[ends - 1] == 10) if len(starts) else ends[:0]  # without the line break
        sums = H.prefix_sums(data) if wanted is not None else None
        number = np.arange(len(starts))
        if wanted is not None:
            number = np.flatnonzero(B.may_contain(wanted, H.run_hash(sums, starts, body)))
            sizes = ends[number] - starts[number]
            into = np.cumsum(sizes) - sizes
            data = data[np.repeat(starts[number] - into, sizes) + np.arange(int(sizes.sum()))]
            found = H.words(data, into)
        else:
            found = H.words(data, starts)
            sums = found.sums
        ids = H.run_hash(sums, starts[number], body[number])
        cell = (found.hash & H.U((1 << FREQUENCY_BITS) - 1)).astype(np.int64)
        key = place[cell].astype(H.U) << H.U(64 - FREQUENCY_BITS) | (found.hash >> H.U(FREQUENCY_BITS))
        line, key = H.distinct(found.row, key, len(number))
        n = np.bincount(line, minlength=len(number))
        long = n >= least
        self.key = key[long[line]]
        self.n, self.id = n[long], ids[long]
        self.first = np.cumsum(self.n) - self.n
        self.line = np.repeat(np.arange(len(self.n)), self.n)
        #: Lines to which only those of the same words are similar.
        self.alike = self.n <= alike
        if self.alike.any():
            sets = np.add.reduceat(H.mix(self.key), self.first)
            self.id = np.where(self.alike, H.mix(sets), self.id)
        at = starts[number[long]]
        self.row = np.searchsorted(chunk.offsets[:-1], at, "right") - 1
        # a line's number: the line breaks between its text's beginning and its own
        self.number = np.searchsorted(breaks, at, "right") - np.searchsorted(breaks, chunk.offsets[self.row], "right")
        self.single = single
        #: Line breaks of each text.
        self.breaks = np.diff(np.searchsorted(breaks, chunk.offsets, "right"))

    def shared(self) -> np.ndarray:
        """Whether the cell of each key has more than one occurrence: they come after the others."""
        return self.key >= H.U(self.single) << H.U(64 - FREQUENCY_BITS)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line, which of 128 hash classes have an odd number of its words."""
        scrambled = self.key * H.U(0x9E3779B97F4A7C15)
        bits = H.U(1) << (scrambled >> H.U(58))
        upper = (scrambled >> H.U(57)) & H.U(1)
        if not len(self.n):
            return bits, bits
        return np.bitwise_xor.reduceat(bits * (H.U(1) - upper), self.first), np.bitwise_xor.reduceat(bits * upper, self.first)


def _differ(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words, at least, in which the lines of two postings differ."""
    return np.bitwise_count(columns[PARITY][a] ^ columns[PARITY][b]) + np.bitwise_count(columns[PARITY_UP][a] ^ columns[PARITY_UP][b])


def allowed(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether length, position and parity allow the similarity of postings of one word."""
    na, nb, at, bt = (c.astype(np.int64) for c in (a[SIZE], b[SIZE], a[PLACE], b[PLACE]))
    need = -(-percent * (na + nb) // (100 + percent))
    most = np.minimum(at, bt) + 1 + np.minimum(na - at - 1, nb - bt - 1)
    differ = np.bitwise_count(a[PARITY] ^ b[PARITY]) + np.bitwise_count(a[PARITY_UP] ^ b[PARITY_UP])
    ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (most >= need) & (na + nb - 2 * need >= differ)
    return (ok | (np.maximum(na, nb) >= MOST)) & (a[LINE] != b[LINE])


def _take(columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    return [c[at] for c in columns]


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Postings by word (48 bits) and size (16 bits)."""
    return _take(columns, np.argsort(columns[WORD] << H.U(16) | columns[SIZE].astype(H.U)))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(key)))


def _passing(columns: list[np.ndarray], right: np.ndarray, start: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the allowed pairs of each posting ``right`` with the ``count`` from ``start`` on."""
    size = columns[SIZE].astype(np.int64)
    # the other line has at most size * 100 / percent words, which bounds the words that differ
    wide = size[right] * 100 // percent + size[right]
    least = np.minimum(wide - 2 * (-(-percent * wide // (100 + percent))) + 2, 255).astype(np.uint8)
    least[size[right] * 100 // percent >= MOST] = 255
    parity, ends, out, lo = columns[PARITY], np.cumsum(count), [], 0
    while lo < len(right):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLAB, "right")))
        times = count[lo:hi]
        left = np.repeat(start[lo:hi] - (ends[lo:hi] - times - done), times) + np.arange(int(ends[hi - 1]) - done)
        near = np.bitwise_count(parity[left] ^ np.repeat(parity[right[lo:hi]], times)) <= np.repeat(least[lo:hi], times)
        own = np.repeat(right[lo:hi], times)[near]
        left = left[near]
        ok = allowed(_take(columns, left), _take(columns, own), percent)
        out.append((left[ok], own[ok]))
        lo = hi
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _nearest(columns: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: int, queries=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs, those of each later posting with its ``limit`` nearest earlier ones by parity (0: all), as
    distinct pairs (earlier line, later line); the postings that had more; and these with all the earlier ones
    that they had.  ``queries`` filters the later lines."""
    doc, number, line = columns[DOC], columns[NUMBER], columns[LINE]
    # rows that repeat an id may have two lines in one place: of these, that of the smaller hash counts as later
    tie = (doc[left] == doc[right]) & ((number[left] > number[right]) | ((number[left] == number[right]) & (line[left] < line[right])))
    swap = (doc[left] > doc[right]) | tie
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    if queries is not None:
        keep = B.may_contain(queries, line[right])
        left, right = left[keep], right[keep]
    noted = near = np.zeros(0, np.int64)
    if limit and len(left):
        order = np.lexsort((number[left], doc[left], _differ(columns, left, right), right))
        left, right = left[order], right[order]
        first, size = _runs(right)
        rank = np.arange(len(right)) - np.repeat(first, size)
        noted = right[rank == limit]
        near = np.unique(np.concatenate([noted, left[np.repeat(size > limit, size)]]))
        left, right = left[rank < limit], right[rank < limit]
    return _distinct(np.stack([line[left], line[right]], 1)), noted, near


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[new]


def _emit(kind: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind], pa.int8()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], schema=OUT)


def _packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [B.to48(columns[WORD]), *columns[1:]]


def alike(percent: int) -> int:
    """The most words of a set to which only an equal one is similar: n of n + 1 are too few."""
    return (percent - 1) // (100 - percent) if percent < 100 else MOST


def _earliest(places: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the places of lines, the first of each line and the others; and which row has each line's first place."""
    line, doc, known, number = places
    order = np.lexsort((known, number, doc, line))
    line, doc, known, number = (c[order] for c in places)
    starts, sizes = _runs(line)
    first = np.repeat(starts, sizes)
    same = (doc == doc[first]) & (number == number[first])
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (known[1:] != known[:-1])
    at = [line, doc, known, number]
    return _take(at, same & new), _take(at, ~same & new), order[starts]


def _once(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of the postings that have word and line in common, the earliest."""
    hashed = H.mix(columns[WORD] * H.U(0x9E3779B97F4A7C15) ^ columns[LINE])
    order = np.argsort(hashed)
    equal = hashed[order[1:]] == hashed[order[:-1]]
    if not equal.any():
        return columns
    some = order[np.append(equal, False) | np.append(False, equal)]
    word, line = columns[WORD][some], columns[LINE][some]
    by = np.lexsort((columns[NUMBER][some], columns[DOC][some], line, word))
    again = (word[by[1:]] == word[by[:-1]]) & (line[by[1:]] == line[by[:-1]])
    keep = np.ones(len(order), bool)
    keep[some[by[1:][again]]] = False
    return _take(columns, keep)


def _map(order, percent: int, buckets: int, frequent: int, least: int):
    """First places, repeats and prefix postings of the lines of the texts, and how many lines each text has."""
    def flush(held: list[tuple[list[np.ndarray], list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        lines, postings = ([np.concatenate(c) for c in zip(*part, strict=True)] for part in zip(*held, strict=True))
        firsts, gone, at = _earliest(lines[:4])
        yield from (_emit(FIRSTS, b, x) for b, x in B.deal(firsts, (firsts[0] % H.U(buckets)).astype(np.int32)))
        if len(gone[0]):
            yield _emit(GONE, int(gone[0][0] % H.U(buckets)), B.pack(gone[1:]))
        # an equal line is passed on once, from its first place
        once = np.zeros(len(lines[0]), bool)
        once[at] = True
        word, place, own = _take(postings, once[postings[2]])
        line, doc, _, number, n, low, high = _take(lines, own)
        columns = [word, line, doc, number, n, place, low, high]
        if not len(word):
            return
        ranked = np.sort(columns[WORD])
        starts, sizes = _runs(ranked)
        words_ = ranked[starts[sizes > frequent]]
        if len(words_):
            often = np.isin(columns[WORD], words_)
            hot = _take(columns, often)
            yield from (_emit(MEMBERS, b, x) for b, x in B.deal(_packed(hot), (hot[LINE] % H.U(buckets)).astype(np.int32)))
            lead = _take(hot, np.unique(hot[WORD], return_index=True)[1])
            yield from (_emit(LEADERS, b, x) for b, x in B.deal(_packed(lead), (lead[WORD] % H.U(buckets)).astype(np.int32)))
            columns = _take(columns, ~often)
        if not len(columns[WORD]):
            return
        yield from (_emit(POSTINGS, b, x) for b, x in B.deal(_packed(columns), (columns[WORD] % H.U(buckets)).astype(np.uint16 if buckets < MOST else np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(False)
            docs = ids.fill_null(int(LAST)).to_numpy(False).astype("<i8")
            texts = np.ones(len(docs), "<u4")
            for chunk in H.chunks(batch.column("text")):
                lines = Lines(chunk, order.value, least, alike(percent))
                texts[chunk.lo:chunk.hi] += lines.breaks.astype("<u4")
                if not len(lines.n):
                    continue
                doc, valid = docs[chunk.lo + lines.row], known[chunk.lo + lines.row].astype(np.uint8)
                prefix = lines.n - -(-percent * lines.n // 100) + 1
                at = np.arange(len(lines.key)) - lines.first[lines.line]
                pick = np.flatnonzero((at < prefix[lines.line]) & lines.shared() & ~lines.alike[lines.line])
                word = H.mix(lines.key[pick]) & H.U((1 << 48) - 1)
                held.append(([lines.id, doc, valid, lines.number.astype("<u4"), np.minimum(lines.n, MOST).astype("<u2"), *lines.parities()],
                             [word, np.minimum(at[pick], MOST).astype("<u2"), rows + lines.line[pick]]))
                rows += len(lines.n)
                size += len(lines.n) + len(pick)
                if size > FLUSH:
                    yield from flush(held)
                    held, size, rows = [], 0, 0
            if len(docs):
                yield _emit(TEXTS, int(docs[0] % buckets), B.pack([docs, known.astype(np.uint8), texts]))
        if size:
            yield from flush(held)
    return run


def _in_lists(columns: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The allowed pairs of sorted postings, each within the list of a word."""
    # smaller lines of the list that are long enough: those before it, from there on
    key, size = columns[WORD] << H.U(16), columns[SIZE].astype(np.int64)
    start = np.searchsorted(key | size.astype(H.U), key | (-(-size * percent // 100)).astype(H.U))
    right = np.arange(len(key))
    return _passing(columns, right, start, right - start, percent)


def _reduce(percent: int, limit: int):
    """First places and repeats of lines, and pairs within the lists of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        places: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if kind in (POSTINGS, LEADERS):
                    held.setdefault(bucket, []).append((kind, blob.as_py()))
                elif kind == FIRSTS:
                    places.setdefault(bucket, []).append(B.unpack(blob.as_py(), AT))
                else:
                    yield _emit(kind, bucket, blob.as_py())
        for bucket in list(places):
            firsts, gone, _ = _earliest([np.concatenate(c) for c in zip(*places.pop(bucket), strict=True)])
            yield _emit(FIRSTS, bucket, B.pack(firsts))
            if len(gone[0]):
                yield _emit(GONE, bucket, B.pack(gone[1:]))
        for bucket in list(held):
            read = [(kind, B.unpack(blob, POSTING)) for kind, blob in held.pop(bucket)]
            columns = _sorted(_once([np.concatenate([c[i] for _, c in read]) for i in range(len(POSTING))]))
            starts, sizes = _runs(columns[WORD])
            if led := [c[WORD] for kind, c in read if kind == LEADERS]:
                wide = np.repeat(np.isin(columns[WORD][starts], np.concatenate(led)), sizes)
                yield _emit(MEMBERS, bucket, B.pack(_packed(_take(columns, wide))))
                columns = _take(columns, ~wide)
                starts, sizes = _runs(columns[WORD])
            pairs, noted, near = _nearest(columns, *_in_lists(columns, percent), limit)
            if len(pairs):
                yield _emit(PAIRS, bucket, B.pack([pairs[:, 0], pairs[:, 1]]))
            if len(noted):
                yield _emit(NOTED, bucket, B.pack([columns[LINE][noted], columns[WORD][noted]]))
                yield _emit(NEAR, bucket, B.pack(_packed(_take(columns, near))))
    return run


def _decode(table: DataFrame, kind: int, kinds: list[str], ddl: str, convert) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                columns = convert(B.unpack(blob.as_py(), kinds))
                for lo in range(0, len(columns[0][1]), 100_000):
                    yield pa.record_batch({name: values[lo:lo + 100_000] for name, values in columns})
    return table.filter(F.col("kind") == kind).select("blob").mapInArrow(run, ddl)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("<u8").view("<i8"), pa.int64())


def _full_sets(source: DataFrame, bits: np.ndarray, order, percent: int, least: int) -> DataFrame:
    """(line, members) of the lines that the filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in H.chunks(batch.column("text")):
                lines = Lines(chunk, order.value, least, alike(percent), bits)
                if len(seen) > SEEN:
                    seen.clear()
                pick = [i for i, s in enumerate(lines.id.tolist()) if not (s in seen or seen.add(s))]
                if pick:
                    yield pa.record_batch({"line": _long(lines.id[pick]), "members": pa.array([lines.key[lines.first[i]:lines.first[i] + lines.n[i]].tobytes() for i in pick], pa.binary())})

    return source.select("text").mapInArrow(run, "line bigint, members binary").dropDuplicates(["line"])


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs of lines whose word sets reach the similarity."""
    rows = (pairs.join(full.withColumnsRenamed({"line": "a", "members": "x"}), "a")
            .join(full.withColumnsRenamed({"line": "b", "members": "y"}), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _searched(table: DataFrame, percent: int, limit: int, words=None, queries=None) -> DataFrame:
    """(a, b, word) within the lists of frequent words, chunk against chunk, as ``_join`` has them; with the
    filters, within the lists of ``words`` alone and of the later lines that ``queries`` lets through."""
    kinds = ["word", "line", "doc", "number", "n", "place", "parity", "parity_up"]

    def convert(c: list[np.ndarray]) -> list[tuple[str, pa.Array]]:
        if words is not None:
            c = _take(c, B.may_contain(words, c[WORD]))
        return [(name, _long(x) if x.dtype.kind == "u" else pa.array(x, pa.int64())) for name, x in zip(kinds, c, strict=True)]

    rows = _decode(table, MEMBERS, POSTING, ", ".join(f"{c} bigint" for c in kinds), convert)
    rows = rows.groupBy("word", "line").agg(F.min(F.struct("doc", "number", "n", "place", "parity", "parity_up")).alias("p")).select("word", "line", "p.*")
    parts = rows.groupBy("word").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    rows = (rows.join(parts, "word").withColumn("own", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("word", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *kinds[1:])
            .repartition("word", "p", "q").sortWithinPartitions("word", "p", "q", "doc", "number", "line"))
    names = ["word", "p", "q", "own", *kinds[1:]]

    def search(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = [held[c].astype(t) for c, t in zip(kinds, ["<u8", "<u8", "<i8", "<u4", "<u2", "<u2", "<u8", "<u8"], strict=True)]
        own, p, q = held["own"], held["p"][0], held["q"][0]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        if p == q:  # each pair of a chunk once
            left, right = _passing(columns, right, np.zeros(len(right), int), np.arange(len(right)), percent)
        else:
            both = _take(columns, np.concatenate([left, right]))
            at = len(left) + np.arange(len(right))
            columns, (left, right) = both, _passing(both, at, np.zeros(len(right), int), np.full(len(right), len(left)), percent)
        pairs, noted, _ = _nearest(columns, left, right, limit, queries)
        more = np.arange(len(pairs) + len(noted)) >= len(pairs)
        return pa.record_batch({"a": _long(np.concatenate([pairs[:, 0], columns[LINE][noted]])),
                                "b": pa.array(np.concatenate([pairs[:, 1], columns[LINE][noted]]).view("<i8"), pa.int64(), mask=more),
                                "word": pa.array(np.concatenate([pairs[:, 1], columns[WORD][noted]]).view("<i8"), pa.int64(), mask=~more)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if rest is not None:
                columns = {c: np.concatenate([rest[c], columns[c]]) for c in names}
            if not len(columns["word"]):
                continue
            new = np.ones(len(columns["word"]), bool)
            new[1:] = (columns["word"][1:] != columns["word"][:-1]) | (columns["p"][1:] != columns["p"][:-1]) | (columns["q"][1:] != columns["q"][:-1])
            cuts = np.flatnonzero(new).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield search({c: columns[c][lo:hi] for c in names})
            rest = {c: columns[c][cuts[-1]:] for c in names}
        if rest is not None:
            yield search(rest)

    return rows.select(*names).mapInArrow(run, "a bigint, b bigint, word bigint")


def _places(table: DataFrame, late: np.ndarray) -> DataFrame:
    """(line, doc, known, number) of the first places of the lines that the filter lets through."""
    def convert(c: list[np.ndarray]) -> list[tuple[str, pa.Array]]:
        c = _take(c, B.may_contain(late, c[0]))
        return [("line", _long(c[0])), ("doc", pa.array(c[1], pa.int64())), ("known", pa.array(c[2] == 1)), ("number", pa.array(c[3].astype(np.int32)))]
    return _decode(table, FIRSTS, AT, "line bigint, doc bigint, known boolean, number int", convert)


def _repeats(table: DataFrame) -> DataFrame:
    """(doc, known, number) of the lines that an earlier one is equal to."""
    def convert(c: list[np.ndarray]) -> list[tuple[str, pa.Array]]:
        return [("doc", pa.array(c[0], pa.int64())), ("known", pa.array(c[1] == 1)), ("number", pa.array(c[2].astype(np.int32)))]
    return _decode(table, GONE, AT[1:], "doc bigint, known boolean, number int", convert)


def _texts(table: DataFrame) -> DataFrame:
    """(doc_id, n_lines) of each text."""
    def convert(c: list[np.ndarray]) -> list[tuple[str, pa.Array]]:
        return [("doc_id", pa.array(c[0], pa.int64(), mask=c[1] == 0)), ("n_lines", pa.array(c[2].astype(np.int32)))]
    return _decode(table, TEXTS, ["<i8", "u1", "<u4"], "doc_id bigint, n_lines int", convert)


def _join(source: DataFrame, order, percent: int, limit: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The table of lines and postings, and pairs (a, b), a the earlier; where a line a had more in the list of a
    word, b is null."""
    buckets = 4 * tasks(source.sparkSession)
    table = store(source.mapInArrow(_map(order, percent, buckets, FREQUENT, least), DDL).repartition("bucket").mapInArrow(_reduce(percent, limit), DDL), "lines")
    pairs = _decode(table, PAIRS, ["<u8", "<u8"], "a bigint, b bigint", lambda c: [("a", _long(c[0])), ("b", _long(c[1]))])
    pairs = pairs.withColumn("word", F.lit(None).cast("long"))
    noted = _decode(table, NOTED, ["<u8", "<u8"], "a bigint, word bigint", lambda c: [("a", _long(c[0])), ("word", _long(c[1]))])
    noted = noted.select("a", F.lit(None).cast("long").alias("b"), "word")
    found = pairs.unionAll(noted).unionAll(_searched(table, percent, limit)).distinct()
    return table, store(found, "pairs")


def _rest(table: DataFrame, percent: int, words: np.ndarray, queries: np.ndarray) -> DataFrame:
    """All pairs (a, b) of the later lines ``queries`` within the lists of ``words``."""
    def convert(c: list[np.ndarray]) -> list[tuple[str, pa.Array]]:
        columns = _sorted(_take(c, B.may_contain(words, c[WORD])))
        pairs = _nearest(columns, *_in_lists(columns, percent), 0, queries)[0]
        return [("a", _long(pairs[:, 0])), ("b", _long(pairs[:, 1]))]

    near = _decode(table, NEAR, POSTING, "a bigint, b bigint", convert)
    return store(near.unionAll(_searched(table, percent, 0, words, queries).select("a", "b")).distinct(), "rest")


def _asked(table: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of the pairs, and those that a second search in the kept postings may pair."""
    near = _decode(table, NEAR, POSTING, "line bigint", lambda c: [("line", _long(np.unique(c[LINE])))])
    return found.filter("b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("line")).unionAll(near)


def _held(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs that verification holds."""
    return store(verified(pairs, full, percent).select(F.col("b").alias("line")).distinct(), "late")


def _repeated(source: DataFrame, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The table of lines and postings, and (doc, removed)."""
    spark = source.sparkSession
    order = spark.sparkContext.broadcast(ordered(frequencies(source)))  # of fixed size
    table, found = _join(source, order, percent, NEAREST, least)
    full = store(_full_sets(source, B.membership(_asked(table, found), "line"), order, percent, least), "sets")
    late = _held(found.filter("b IS NOT NULL"), full, percent)
    open_lines = store(found.filter("b IS NULL").select(F.col("a").alias("line"), "word").join(late, "line", "left_anti"), "open")
    if not open_lines.isEmpty():
        queries = B.membership(open_lines, "line")
        words = B.membership(open_lines, "word")
        rest = _rest(table, percent, words, queries).join(found, ["a", "b"], "left_anti")
        # only lists of frequent words pair lines whose sets were not taken
        lacking = store(rest.select(F.explode(F.array("a", "b")).alias("line")).distinct().join(full, "line", "left_anti"), "lacking")
        if not lacking.isEmpty():
            more = _full_sets(source, B.membership(lacking, "line"), order, percent, least)
            full = store(full.unionAll(more.join(lacking, "line", "left_semi")), "sets")
        late = late.unionAll(_held(rest, full, percent)).distinct()

    firsts = _places(table, B.membership(late, "line")).join(late, "line", "left_semi").drop("line")
    gone = _repeats(table).unionAll(firsts).select(F.when(F.col("known"), F.col("doc")).alias("doc"), "number")
    return table, gone.groupBy("doc").agg(F.sort_array(F.collect_set("number")).alias("removed"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, removed): places, from 0, of the lines to remove from each document that has any."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _repeated(source, percent, max(1, min_words))[1].withColumnRenamed("doc", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated lines, and without the documents of which nothing is left."""
    removed = repeated_lines(docs, id_col, text_col, percent, min_words).withColumnsRenamed({id_col: "__id", "removed": "__removed"})
    both = docs.join(removed, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)
    out = both.withColumn(text_col, text).filter(F.col("__removed").isNull() | (F.trim(F.col(text_col)) != ""))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table, removed = _repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PERCENT, 1)
    sizes = _texts(table).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    out = sizes.join(removed, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
