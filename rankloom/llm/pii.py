"""Information-theoretic sanitisation of personal data.

Four kinds of base spans (email, ip, card, phone) are found by pattern. Each distinct value is a protected entity.
A term (word) that stands near an entity, ``WINDOW`` words to either side whatever lines they are in, may give it
away even where the value itself is masked. How strongly is estimated for every entity over the whole corpus: with
c(t, e) documents that hold both near each other, c(t), c(e) and N documents, it reveals
PMI = log2(N c(t, e) / (c(t) c(e))) bits of the -log2(c(e) / N) bits that the entity carries. Terms that reveal at
least ``threshold`` of them are masked in the whole documents that hold the entity: generalised to a class of words,
or removed if they reveal at least ``remove`` of them.

Small counts: any word of a single document reveals all about a value that stands in that document only. Where t and
e meet in k different windows (copies count once) and k is below ``min_lines``, the term counts only if chance does not
explain it: of V terms at most about as frequent as t (within a power of two), chance puts at most V m^k / k! near k of
the K windows of e, m = K c(t) / N; this has to be ``chance`` at most.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import slices, stored

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a run of digits is taken whole from its first digit, so no other start inside it need be tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"\w+(?:['’-]\w+)*")
#: Words to either side of an entity that stand near it.
WINDOW = 24
#: Different terms that a task counts before it hands them on.
TERMS_HELD = 200_000
#: Documents are sorted out by the bucket of their text before those with disclosing terms are joined.
BUCKETS = 1 << 20


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ``@`` with the whole run of name signs before it, in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start; matches that fail a test are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity_key(kind: str, value: str) -> int:
    """A 63-bit key of a protected value, alike for its spellings."""
    plain = value.lower() if kind == "email" else "".join(c for c in value if c.isdigit() or c == "." and kind == "ip")
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little") >> 1


def terms_of(text: str, spans: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Words outside base spans, lower-cased, with their places."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in (base_spans(text) if spans is None else spans)):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    out, k = [], 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            out.append((m[0].lower(), *m.span()))
    return out


def short_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") >> 1


def near(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """For each entity of a text the different terms near it, and a hash of what stands near it."""
    words = terms_of(text, spans)
    starts = [a for _, a, _ in words]
    held: dict[int, list[str]] = {}
    for kind, a, b in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        held.setdefault(entity_key(kind, text[a:b]), []).extend(t for t, _, _ in words[max(0, i - WINDOW):i] + words[j:j + WINDOW])
    return [{"entity": e, "window": short_hash("\0".join(w)), "terms": sorted(set(w))} for e, w in held.items()]


FOUND = "near array<struct<entity:long,window:long,terms:array<string>>>, key long"
KIND_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("window", pa.int64()), ("terms", pa.list_(pa.string()))]))


def text_key(text: str) -> Column:
    return F.xxhash64(F.col(text), F.octet_length(text))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's entities with what stands near them; rows without entities are left out. ``key`` is of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            out, keys = [], []
            for t, key in zip(raw, part["key"].to_pylist(), strict=True):
                s = t.decode("utf-8", "replace")
                if found := base_spans(s):
                    out.append(near(s, found))
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out, KIND_NEAR), pa.array(keys, pa.int64())], ["near", "key"])

    return docs.select(docs[text].cast("string").alias("text")).withColumn("key", text_key("text")).mapInArrow(run, FOUND)


def count_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): rows that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return out

        for _, raw in slices(batches, "text"):
            for t in raw:
                seen.update({w.lower() for w in set(TERM.findall(t.decode("utf-8", "replace")))})
                if len(seen) > TERMS_HELD:
                    yield flush()
        yield flush()

    return docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosure(docs: DataFrame, found: DataFrame, threshold: float = 0.8, min_lines: int = 3, text: str = "text", chance: float = 0.05) -> DataFrame:
    """(entity, term, reveals): terms that give an entity away, with the part of its information they reveal."""
    met = found.select(F.explode("near").alias("x")).select("x.entity", "x.window", "x.terms")
    entity = met.groupBy("entity", "window").agg(F.count(F.lit(1)).alias("c")).groupBy("entity").agg(F.sum("c").alias("c_e"), F.count(F.lit(1)).alias("k_e"))
    both = met.select("entity", "window", F.explode("terms").alias("term")).groupBy("entity", "term", "window").agg(F.count(F.lit(1)).alias("c"))
    both = both.groupBy("entity", "term").agg(F.sum("c").alias("c_te"), F.count(F.lit(1)).alias("k"))
    counts = stored(count_terms(docs, text), "counts")
    level = F.floor(F.log2("n")).cast("int")
    by_level = {r["level"]: r["v"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()}
    vocabulary = F.array(*[F.lit(float(sum(v for at, v in by_level.items() if at <= k))) for k in range(64)])
    total = F.lit(float(docs.count()))
    scored = both.join(entity, "entity").join(counts, "term")
    by_chance = vocabulary[level] * F.pow(F.col("k_e") * F.col("n") / total, F.col("k")) / F.factorial(F.least(F.col("k"), F.lit(20)).cast("int"))
    scored = scored.where((F.col("k") >= min_lines) | (by_chance <= chance))
    bits = F.log2(total / F.col("c_e"))
    pmi = F.log2(total * F.col("c_te") / (F.col("n") * F.col("c_e")))
    scored = scored.select("entity", "term", F.when(bits > 0, pmi / bits).otherwise(0.0).alias("reveals"))
    return stored(scored.where(F.col("reveals") >= threshold), "disclosing")


def disclosed(found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(key, told): for each text the terms that give one of its entities away."""
    held = found.select("key", F.explode("near.entity").alias("entity")).distinct()
    terms = held.join(disclosing, "entity").groupBy("key", "term").agg(F.max("reveals").alias("reveals"))
    return stored(terms.groupBy("key").agg(F.collect_list(F.struct("term", "reveals")).alias("told")), "told")


def with_told(src: DataFrame, text: str, told: DataFrame) -> DataFrame:
    """``src`` with the column ``told``. Only rows whose text may have one are joined."""
    src = src.withColumn("key", text_key(text))
    bucket = F.pmod("key", F.lit(BUCKETS)).cast("int")
    wanted = F.broadcast(told.select(bucket.alias("bucket")).distinct())  # at most BUCKETS numbers
    src = src.withColumn("bucket", bucket)
    some = src.join(wanted, "bucket", "left_semi").drop("bucket").join(told, "key", "left")
    rest = src.join(wanted, "bucket", "left_anti").drop("bucket").withColumn("told", F.lit(None).cast(told.schema["told"].dataType))
    return some.unionByName(rest).drop("key")


def places(text: str, spans: list[tuple[str, int, int]], told: list[dict] | None) -> list[tuple[int, int, float]]:
    """Where a text's disclosing terms stand."""
    reveals = {x["term"]: x["reveals"] for x in told or []}
    return [(a, b, reveals[t]) for t, a, b in terms_of(text, spans) if t in reveals] if reveals else []


def generalise(term: str) -> str:
    """The class of words a term belongs to."""
    return "[NUMBER]" if any(map(str.isdigit, term)) else "[NAME]" if term[:1].isupper() else "[TERM]"


def mask(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, float]], remove: float) -> str:
    """The text with base values as ``[KIND]`` and disclosing terms generalised or removed; overlaps: the first stays."""
    parts = sorted([(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(a, b, "" if r >= remove else generalise(text[a:b])) for a, b, r in terms])
    out, at = [], 0
    for a, b, new in parts:
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:  # what sticks out of an earlier span goes with it
            at = b
    return "".join([*out, text[at:]])


KIND_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("finish", pa.int32())]))
KIND_TERMS = pa.list_(pa.struct([("begin", pa.int32()), ("finish", pa.int32()), ("reveals", pa.float64())]))


def detect(docs: DataFrame, threshold: float = 0.8, min_lines: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans, terms): base spans and disclosing terms of every row; empty arrays where there are none.

    A null or empty text has none. Rows of one id are each judged by their own text.
    """
    found = stored(find(docs, doc_id, text), "found")
    told = disclosed(found, disclosure(docs, found, threshold, min_lines, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            spans, terms = [], []
            for t, given in zip(raw, part["told"].to_pylist(), strict=True):
                s = t.decode("utf-8", "replace")
                base = base_spans(s)
                spans.append([{"kind": k, "begin": a, "finish": b} for k, a, b in base])
                terms.append([{"begin": a, "finish": b, "reveals": r} for a, b, r in places(s, base, given)])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(spans, KIND_SPANS), pa.array(terms, KIND_TERMS)], ["doc_id", "spans", "terms"])

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = "doc_id long, spans array<struct<kind:string,begin:int,finish:int>>, terms array<struct<begin:int,finish:int,reveals:double>>"
    return with_told(src, "text", told).mapInArrow(run, kind)


def digests(detected: DataFrame) -> DataFrame:
    """Counts by kind and the digest columns of ``detect``'s rows; a term is a span of kind ``term``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            shas, texts = [], []
            for spans, terms in zip(b["spans"].to_pylist(), b["terms"].to_pylist(), strict=True):
                base = [(s["kind"], s["begin"], s["finish"]) for s in spans]
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                texts.append(digest(base + [("term", t["begin"], t["finish"]) for t in terms]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return detected.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(docs: DataFrame, threshold: float = 0.8, min_lines: int = 3, remove: float = 0.95, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text masked; its other columns and its rows stay, a null text stays null."""
    found = stored(find(docs, doc_id, text), "found")
    told = disclosed(found, disclosure(docs, found, threshold, min_lines, text))
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)
    src = with_told(docs.toDF(*names), names[at], told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, names[at]):
            out = []
            for t, given, terms in zip(raw, part[names[at]].to_pylist(), part["told"].to_pylist(), strict=True):
                s = t.decode("utf-8", "replace")
                base = base_spans(s)
                out.append(None if given is None else mask(s, base, places(s, base, terms), remove))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == names[at] else part[n] for n in names], names)

    masked = src.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)))
    return masked.toDF(*docs.columns)
