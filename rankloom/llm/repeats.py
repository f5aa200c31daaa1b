"""Removal of long byte strings that stand in the corpus more than once, by suffix arrays of their surroundings.

Every string of ``SPAN`` bytes holds a least-hashed gram of ``GRAM`` bytes, its anchor, chosen by the bytes alone; so
equal strings have equal anchors at equal distances. The starts that share one anchor are a piece of the text, with
the bytes of all their strings. Anchors (and whole pieces) met once need no more work. Of an anchor whose pieces
differ, each different piece moves once, with its bytes, to the task of that anchor.

That task concatenates pieces and sorts their suffixes in two stages: suffixes smaller than their successors are
sorted directly, by eight bytes at a time to the depth of ``SPAN``; all others are induced by one scan over the
buckets of first bytes, in which a suffix puts the one before it behind those already in its bucket. Common prefixes
of adjacent suffixes then tell the starts whose strings occur again. A piece that stands in the corpus twice is
repeated as a whole and is there as a partner for others.

Where the pieces of an anchor are too many for one task, they are cut in two by the distance of start and anchor and
keyed by the longer part that all strings of that distance share; after eight halvings a key is a whole string.

Texts are UTF-8 bytes, null is empty, strings never cross texts; every row is judged by all rows, its equals included.
Keys of texts are 64-bit hashes: a clash joins the lists of two texts, which are facts about pieces, and does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import _BYTE, _powers, forget, mix, signed, slices, stored

SPAN = 200
GRAM = 32
REACH = SPAN - GRAM
#: Bytes of pieces that are sorted at once, and that one key may bring.
SORT_BYTES = 4 << 20
_LONG_TEXT = 1 << 20
_AT = np.uint64((1 << 24) - 1)


def _buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end: (bytes, number of each text, where it is, its offset); long ones in parts that overlap."""
    data, number, offset, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), _LONG_TEXT):
            part = t[at:at + _LONG_TEXT + SPAN - 1]
            data.append(part)
            number.append(i)
            offset.append(at)
            held += len(part)
            if held > 2 * _LONG_TEXT:
                yield _joined(data, number, offset)
                data, number, offset, held = [], [], [], 0
    if data:
        yield _joined(data, number, offset)


def _joined(data: list[bytes], number: list[int], offset: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    where = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    return np.frombuffer(b"".join(data), np.uint8), np.array(number), where, np.array(offset)


def _least_before(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Pieces:
    """The pieces of a run of texts: text, first start, number of starts, anchor, keys of anchor and piece."""

    def __init__(self, texts: list[bytes]):
        found = [self._of(*b) for b in _buffers(texts)]
        empty = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        self.text, self.first, self.count, self.anchor, self.key, self.piece = (
            np.concatenate(x) for x in zip(empty, *found, strict=True))

    @staticmethod
    def _of(buf: np.ndarray, number: np.ndarray, where: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
        n = len(buf)
        if n < SPAN:
            return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        power, inverse = _powers(1 << int(n).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[:n], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
        # the upper bits decide, equal ones the place: the leftmost
        least = _least_before((grams & ~_AT) | np.arange(len(grams), dtype=np.uint64), REACH + 1)
        anchor = (least & _AT).astype(np.int64)
        room = np.repeat(where[1:], np.diff(where))  # end of the text that holds each byte
        start = np.flatnonzero(np.arange(len(anchor)) + SPAN <= room[:len(anchor)])
        anchor, end = anchor[start], room[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1])
        opens = np.flatnonzero(fresh)
        count = np.diff(np.append(opens, len(start)))
        first, anchor = start[opens], anchor[opens]
        stop = first + count + SPAN - 1
        shape = ((anchor - first).astype(np.uint64) << np.uint64(16)) + count.astype(np.uint64)
        piece = mix((sums[stop] - sums[first]) * inverse[first] + mix(shape))
        at = np.searchsorted(where, first, side="right") - 1
        shift = offset[at] - where[at]
        return [number[at], first + shift, count, anchor + shift, grams[anchor], piece]


def _bits(anchor: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """One number for an anchor's key and a piece's."""
    return mix(anchor ^ mix(piece))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text hash, anchor, name of the piece, twice) once for every different piece of every different text of a slice."""
    for part, texts in slices(batches, "text"):
        hashes, opens, many = np.unique(np.asarray(part.column(0)), return_index=True, return_counts=True)
        p = Pieces([texts[i] for i in opens])
        by = np.lexsort((p.piece, p.key, p.text))
        text, key, piece = p.text[by], p.key[by], p.piece[by]
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        twice = (np.diff(np.append(first, len(by))) > 1) | (many[text[first]] > 1)
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(hashes[text[first]], pa.int64()), "anchor": pa.array(signed(key[first]), pa.int64()),
            "id": pa.array(signed(_bits(key[first], piece[first])), pa.int64()), "twice": pa.array(twice, pa.bool_()),
        })


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked pieces of texts, with their bytes."""
    for part, texts in slices(batches, "text"):
        asked = part.column(part.schema.get_field_index("asked"))
        sizes = np.diff(np.asarray(asked.offsets))
        wanted = np.unique(np.repeat(np.arange(len(texts)), sizes).astype(np.uint64) ^ mix(np.asarray(asked.flatten()).view(np.uint64)))
        p = Pieces(texts)
        here = np.flatnonzero(np.isin(p.text.astype(np.uint64) ^ mix(_bits(p.key, p.piece)), wanted))
        _, only = np.unique(_bits(p.key[here], p.piece[here]), return_index=True)
        here = here[only]
        yield pa.RecordBatch.from_pydict({
            "grp": pa.array(signed(p.key[here]), pa.int64()), "id": pa.array(signed(_bits(p.key[here], p.piece[here])), pa.int64()),
            "skip": pa.array(np.zeros(len(here)), pa.int32()), "anchor": pa.array(p.anchor[here] - p.first[here], pa.int32()),
            "near": pa.array(np.zeros(len(here)), pa.int32()), "far": pa.array(np.full(len(here), REACH), pa.int32()),
            "body": pa.array([texts[t][f:f + c + SPAN - 1] for t, f, c in zip(p.text[here], p.first[here], p.count[here], strict=True)], pa.binary()),
        })


def suffix_array(buf: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ``buf`` in order of their first ``depth`` bytes, by two stages.

    With ``wanted``, of these and of what induces them: from a larger suffix on up to the next smaller one.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    # a suffix is smaller than its successor where the next different byte is larger; the end is smallest
    change = np.flatnonzero(buf[1:] != buf[:-1])
    rises = np.append(buf[change + 1] > buf[change], False)
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], change, [n - 1]))))
    need = np.ones(n, bool) if wanted is None else wanted.copy()
    if wanted is not None:
        following = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~smaller)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, last, 1)
        np.add.at(edge, following[last] + 1, -1)
        need |= np.cumsum(edge[:-1]) > 0
    direct = _sorted_directly(buf, np.flatnonzero(smaller & need), depth)
    cut = np.searchsorted(buf[direct], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1]:
        arrived[buf[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        larger = []
        todo = np.concatenate(arrived[c]) if arrived[c] else np.empty(0, np.int64)
        arrived[c] = []
        while len(todo):
            larger.append(todo)
            before = todo[todo > 0] - 1
            todo = before[(buf[before] == c) & need[before]]  # of one run of a byte, found from its end
        bucket = np.concatenate([*larger, direct[cut[c]:cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = buf[before]
        keep = (byte > c) & need[before]
        before, byte = before[keep], byte[keep]
        if len(before):
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            edge = np.flatnonzero(np.diff(byte)) + 1
            for b, group in zip(byte[np.concatenate(([0], edge))], np.split(before, edge), strict=True):
                arrived[b].append(group)
    return np.concatenate(out)


def _words(buf: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros behind the end."""
    padded = np.concatenate((buf, np.zeros(more + 8, np.uint8)))
    return np.ndarray(len(buf) + more, dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def _sorted_directly(buf: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """``start`` in order of the first ``depth`` bytes from there on.

    Eight bytes a round; only groups that these bytes tell apart are sorted, only places in groups of two go on.
    """
    if not len(start):
        return start
    word = _words(buf, depth + 8)
    out = start[np.argsort(word[start], kind="stable")]
    key = word[out]
    slot = np.arange(len(out))
    new = np.ones(len(out), bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~(new & np.append(new[1:], True))
        slot, new = slot[tied], new[tied]
        if not len(slot):
            break
        key = word[out[slot] + at]
        opens = np.flatnonzero(new)
        mixed = np.minimum.reduceat(key, opens) != np.maximum.reduceat(key, opens)
        if mixed.any():
            size = np.diff(np.append(opens, len(slot)))
            part = np.flatnonzero(np.repeat(mixed, size))
            group = np.cumsum(new)[part]
            by = np.lexsort((key[part], group))
            out[slot[part]] = out[slot[part[by]]]
            sub, group = key[part[by]], group[by]
            split = np.ones(len(part), bool)
            split[1:] = (sub[1:] != sub[:-1]) | (group[1:] != group[:-1])
            new[part] = split
    return out


def adjacent_prefixes(buf: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each of ``order`` has in common with the one before it, up to ``depth``; 0 for the first."""
    word = _words(buf, depth + 8)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for d in range(0, depth, 8):
        differ = word[order[at] + d].astype(np.uint64) ^ word[order[at - 1] + d].astype(np.uint64)
        same = np.full(len(at), 8)
        odd = differ != 0
        bits = 63 - np.floor(np.log2(np.maximum(differ[odd] >> np.uint64(11), np.uint64(1)).astype(np.float64))).astype(np.int64) - 11
        bits[(differ[odd] >> np.uint64(11)) == 0] = 56  # only in the last bytes, told apart below
        low = differ[odd]
        same[odd] = np.where(low >> np.uint64(11), bits // 8, np.where(low > 255, 6, 7))
        out[at] += same
        at = at[~odd]
        if not len(at):
            break
    return np.minimum(out, depth)


def repeated_starts(bodies: list[bytes]) -> np.ndarray:
    """For the starts of all pieces, end to end, whether their strings occur at another start."""
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    count = sizes - SPAN + 1
    own = np.arange(len(buf)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(count, sizes)
    order = suffix_array(buf, SPAN, own)
    order = order[own[order]]
    equal = adjacent_prefixes(buf, order, SPAN) >= SPAN
    hit = np.zeros(len(buf), bool)
    hit[order] = equal | np.append(equal[1:], False)
    return hit[own]


PIECE = "grp long, id long, skip int, anchor int, near int, far int, body binary"
RESULT = "id long, begin int, finish int, " + PIECE.replace("id long, ", "")


def _sorter(limit: int):
    """Pieces by key to runs of repeated starts, or to halves where a key has more than ``limit`` bytes."""

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hit = repeated_starts([r[6] for r in rows])
        count = np.array([len(r[6]) - SPAN + 1 for r in rows])
        base = np.cumsum(count) - count
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        begin, finish = edge[0::2], edge[1::2]
        # a run may go over from one piece to the next
        lo = np.searchsorted(base, begin, side="right") - 1
        hi = np.searchsorted(base, finish - 1, side="right") - 1
        piece = np.repeat(lo, hi - lo + 1) + np.arange(int((hi - lo + 1).sum())) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
        run = np.repeat(np.arange(len(lo)), hi - lo + 1)
        skip = np.array([r[2] for r in rows])
        b = np.maximum(begin[run], base[piece]) - base[piece] + skip[piece]
        f = np.minimum(finish[run], base[piece] + count[piece]) - base[piece] + skip[piece]
        ids = np.array([r[1] for r in rows])
        yield answer(ids[piece], b, f)

    def answer(ids, begin, finish) -> pa.RecordBatch:
        none = {n: pa.nulls(len(ids), t) for n, t in (("grp", pa.int64()), ("skip", pa.int32()), ("anchor", pa.int32()), ("near", pa.int32()), ("far", pa.int32()), ("body", pa.binary()))}
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "begin": pa.array(begin, pa.int32()), "finish": pa.array(finish, pa.int32())} | none)

    def halves(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, name, skip, anchor, near, far, body in rows:
            if near == far:  # the key is the string itself
                yield answer([name], [skip], [skip + 1])
                continue
            last = skip + len(body) - SPAN  # starts skip..last lie anchor - start before the anchor
            mid = (near + far) // 2
            for lo, hi in ((near, mid), (mid + 1, far)):
                a, b = max(skip, anchor - hi), min(last, anchor - lo)
                if a <= b:
                    shared = body[anchor - lo - skip:anchor - hi + SPAN - skip]
                    key = hashlib.blake2b(shared, digest_size=8, salt=b"%d-%d" % (lo, hi)).digest()
                    out.append((int.from_bytes(key, "little", signed=True), name, a, anchor, lo, hi, body[a - skip:b - skip + SPAN]))
        if out:
            g, name, skip, anchor, lo, hi, body = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(name, pa.int64()), "begin": pa.nulls(len(out), pa.int32()), "finish": pa.nulls(len(out), pa.int32()),
                "grp": pa.array(g, pa.int64()), "skip": pa.array(skip, pa.int32()), "anchor": pa.array(anchor, pa.int32()),
                "near": pa.array(lo, pa.int32()), "far": pa.array(hi, pa.int32()), "body": pa.array(body, pa.binary()),
            })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # of whole keys
        group: list[tuple] = []  # of the key being read
        held = size = 0
        split = False
        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if last is not None and row[0] != last[0]:
                    if split:
                        yield from halves(group)
                    elif len(group) > 1:  # a piece that stands alone has no partner
                        ready += group
                        held += size
                    if held > limit:
                        yield from results(ready)
                        ready, held = [], 0
                    group, size, split = [], 0, False
                elif last is not None and row[1:3] == last[1:3]:
                    continue  # the same piece, from an equal text
                last = row
                group.append(row)
                size += len(row[6])
                if size > limit:
                    yield from halves(group)
                    group, size, split = [], 0, True
        if split:
            yield from halves(group)
        elif len(group) > 1:
            ready += group
        if ready:
            yield from results(ready)

    return work


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs that the strings of runs of starts cover; ``spans`` are in order."""
    out: list[tuple[int, int]] = []
    for b, f in spans:
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], f + SPAN - 1))
        else:
            out.append((b, f + SPAN - 1))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``docs`` with ``spans`` (byte runs to remove, by start) and ``kept``, the remaining bytes as binary.

    A byte goes if a string of 200 bytes over it also starts anywhere else in the column; strings are judged on the
    texts as they come in. ``spans`` or ``kept`` among the columns are replaced; the text column stays.
    """
    others = [c for c in docs.columns if c not in ("spans", "kept")]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = docs.select(F.xxhash64(content).alias("h"), content.alias("text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others) if c != text])
    texts = named.select("h", "text").where(F.octet_length("text") >= SPAN)

    keys = texts.mapInArrow(_keys, "h long, anchor long, id long, twice boolean")
    same, of_anchor = W.partitionBy("anchor", "id"), W.partitionBy("anchor")
    met = F.sum(F.when(F.col("twice"), 2).otherwise(1))
    seen = (
        keys.withColumn("nr", F.row_number().over(same.orderBy("h"))).withColumn("prev", F.lag("h").over(same.orderBy("h")))
        .withColumn("copies", met.over(same))
        .withColumn("total", met.over(of_anchor))
        .withColumn("differ", F.min("id").over(of_anchor) != F.max("id").over(of_anchor))
        .where("total > 1 and (prev is null or prev <> h)")
    )
    pieces = stored(seen.select("h", "id", (F.col("copies") > 1).alias("whole"), (F.col("differ") & (F.col("nr") == 1)).alias("ask")), "pieces")
    asked = pieces.where("ask").groupBy("h").agg(F.collect_set("id").alias("asked"))
    todo = texts.join(asked, "h").select("h", "text", "asked").mapInArrow(_asked, PIECE)
    done, spent = [], []
    while True:
        out = stored(todo.repartition("grp").sortWithinPartitions("grp", "id", "skip").mapInArrow(_sorter(sort_bytes), RESULT), "repeats")
        done.append(out.where("begin is not null").select("id", "begin", "finish"))
        spent.append(out)
        todo = out.where("begin is null").select(*[c.split()[0] for c in PIECE.split(", ")])
        if todo.isEmpty():
            break
    runs = done[0]
    for d in done[1:]:
        runs = runs.unionByName(d)
    runs = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("begin", "finish"))).alias("runs"))
    part = pieces.where("not whole").join(runs, "id").select("h", "id", "runs")
    whole = pieces.where("whole").select("h", "id", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    lists = stored(part.unionByName(whole).groupBy("h").agg(F.collect_list(F.struct("id", "runs")).alias("repeated")), "repeated")
    forget(pieces, *spent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in slices(batches, "text"):
            lists = part.column(part.schema.get_field_index("repeated")).to_pylist()
            have = [i for i, r in enumerate(lists) if r]
            p = Pieces([data[i] for i in have])
            ids = signed(_bits(p.key, p.piece)).tolist()
            edge = np.searchsorted(p.text, np.arange(len(have) + 1))
            first, count = p.first.tolist(), p.count.tolist()
            spans: list[list[tuple[int, int]]] = [[] for _ in data]
            for k, i in enumerate(have):
                known = {r["id"]: r["runs"] for r in lists[i]}
                starts: list[tuple[int, int]] = []
                for j in range(edge[k], edge[k + 1]):
                    if ids[j] in known:
                        runs = known[ids[j]]
                        f = first[j]
                        starts += [(f, f + count[j])] if runs is None else [(f + r["begin"], f + r["finish"]) for r in runs]
                spans[i] = _covered(starts)
            kept = []
            for d, s in zip(data, spans, strict=True):
                cuts = [0, *[x for span in s for x in span], len(d)]
                kept.append(b"".join(d[a:b] for a, b in zip(cuts[0::2], cuts[1::2], strict=True)) if s else d)
            keep = part.select([c for c in part.schema.names if c not in ("h", "repeated")])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[*keep.schema.names, "spans", "kept"],
            )

    joined = named.join(lists, "h", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields if f.name != "h")
    out = joined.select("h", *[f.name for f in named.schema.fields if f.name != "h"], "repeated").mapInArrow(
        work, f"{schema}, spans array<struct<start:bigint,end:bigint>>, kept binary")
    plain = [F.col("text" if c == text else f"_c{i}").alias(c) for i, c in enumerate(others)]
    return out.select(*plain, "spans", "kept")


#: The query in SQL: a 64-bit hash of the string at every start, in chunks of 512 starts.
SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 c AS (SELECT r, n, j, substring(x, 1024 * j + 1, 1424) AS y FROM (SELECT r, x, len(x) // 2 AS n, unnest(range(0, len(x) // 1024 + 1)) AS j FROM d)),
 s AS (SELECT r, 512 * j + o AS i, hash(substring(y, 2 * o + 1, 400)) AS h FROM (SELECT r, j, y, unnest(range(0, least(512, n - 199 - 512 * j))) AS o FROM c)),
 t AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
 g AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM (
   SELECT r, i, CAST(i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 200 AS INTEGER) AS fresh FROM t)) GROUP BY r, k),
 k AS (SELECT r, count(*) - 1 AS n_spans, sum(b - a) AS kept, string_agg(substring(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM (
   SELECT r, x, coalesce(lag(e) OVER (PARTITION BY r ORDER BY f, e), 0) AS a, f AS b FROM (
     SELECT r, x, g.a AS f, g.b AS e FROM d JOIN g USING (r) UNION ALL SELECT r, x, len(x) // 2, 1000000000000 FROM d)) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(len(x) // 2 - kept AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM d JOIN k USING (r)"""
