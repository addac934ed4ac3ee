"""Near-duplicate records with small edits: T-occurrence search over inverted lists of shingles.

Two sets with shared / all >= t share at least T = ceil(t / (1 + t) * (|a| + |b|)) shingles. Following
DivideSkip, a record's lists are divided by length: its L longest are set aside, L = T / (mu * log M + 1) for the
least T its size allows and M records. Two records that share T shingles occur together on at least T - max(L) of the
lists that are short for both. So only postings of short lists are sent out; the lists are merged and occurrences counted per pair
of records; pairs with too few fall away, and for the rest the long lists are probed by binary search. What the merge
counted and the probes hit is the overlap, which must reach T.

Before it counts, the merge passes over a pair whose sizes or bit sketches rule the similarity out. A list
too long for a task is cut into segments, and tasks merge pairs of segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.plain import words
from graphlake.session import cut_lineage

#: Records from which the frequent shingles are learned, and how many of these are kept; they only set
#: the order of the lists, by which no pair is lost.
ORDER_SAMPLE = 20_000
ORDER_TERMS = 524_288
#: Characters of text worked on at once.
TEXT_BLOCK = 4_000_000
#: Weight of a probe against a merge step in the division of lists.
MU = 0.01
#: Records of a list's segment; longer lists are merged segment by segment.
SEGMENT = 2_048
#: Records per bucket of lists at least as many buckets are made for.
BUCKET_RECORDS = 50_000
#: Exact copies (records of a class with the very same text) up to this many are listed pair by pair; of more, each is
#: linked to their representative, which alone stands for them towards other texts, of their class too.
EXPAND = 32
#: Size up to which the list of records to read again is broadcast.
LIST_BYTES = 64 << 20
#: Members of a class that meet in one task at once.
SALT = 512

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class _Names(dict):
    """Hashes of words, each made when first asked for."""

    def __missing__(self, word: str) -> int:
        name = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return name


def shingles(kinds: list[str], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(record, code) of the distinct shingles, ordered; kind 'w3' is three words in a row, 'c3' three characters of the words joined by blanks."""
    vocabulary = _Names()
    records, codes = [], []
    for kind in sorted(set(kinds)):
        n, chars = int(kind[1:]), kind[0] == "c"
        units, owner = [], []
        for i, (k, text) in enumerate(zip(kinds, texts, strict=True)):
            if k != kind:
                continue
            tokens = words(text)
            if chars:
                unit = np.frombuffer(" ".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            else:
                unit = np.fromiter(map(vocabulary.__getitem__, tokens), np.uint64, len(tokens))
            if len(unit) >= n:
                units.append(unit)
                owner.append(np.full(len(unit), i, np.int64))
        if not units:
            continue
        unit, of = np.concatenate(units), np.concatenate(owner)
        code = np.full(len(unit) - n + 1, xxhash.xxh64_intdigest(kind), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + unit[j : len(unit) - n + 1 + j])
        whole = of[: len(code)] == of[n - 1 :]
        records.append(of[: len(code)][whole])
        codes.append(code[whole])
    if not records:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    record, code = np.concatenate(records), np.concatenate(codes)
    order = np.lexsort((code, record))
    record, code = record[order], code[order]
    first = np.ones(len(code), bool)
    first[1:] = (record[1:] != record[:-1]) | (code[1:] != code[:-1])
    return record[first], code[first]


def _blocks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch with at most TEXT_BLOCK characters and 60,000 rows (or one row)."""
    size = batch["text"].str.len().fillna(0).to_numpy()
    part = np.cumsum(size) // TEXT_BLOCK + np.arange(len(batch)) // 60_000
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def _signature(codes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes())).astype(np.int64))


def _copy(text: str | None) -> int:
    """Names a text; exact copies have the same name."""
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))).astype(np.int64))


def _learn_order(records: DataFrame, n: int) -> np.ndarray:
    """Codes of frequent shingles of a bounded sample, and their counts there, by code."""
    step = max(1, n // ORDER_SAMPLE)
    sample = records.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for rows in _blocks(batch):
                new, n = np.unique(shingles(rows["kind"].tolist(), rows["text"].tolist())[1], return_counts=True)
                code, at = np.unique(np.concatenate([code, new]), return_inverse=True)
                c = np.bincount(at, np.concatenate([c, n]), len(code)).astype(np.int64)
        # what a task sees once tells nothing of the order
        yield pd.DataFrame({"code": code[c > 1].astype(np.int64), "c": c[c > 1]})

    counts = sample.mapInPandas(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    rows = counts.orderBy(F.desc("c"), "code").limit(ORDER_TERMS).toArrow()
    table = np.stack([rows["code"].to_numpy(), rows["c"].to_numpy()], 1).astype(np.int64).reshape(-1, 2)
    return table[np.argsort(table[:, 0].astype(np.uint64))]


_SENT = "bucket int, kind string, key string, version double, sig long, size int, copy long, blob binary"
_DOC = np.dtype([("sig", "<i8"), ("size", "<u4"), ("n", "<u4")])
#: Bits of a record's sketch: this many for up to 192 shingles, doubled with the size up to so often.
_SKETCH, _LEVELS = 256, 6


def _set_aside(size: np.ndarray, least: Fraction, share: float) -> np.ndarray:
    """Long lists of records of these sizes."""
    needed = -(-least.numerator * size // least.denominator)
    return np.maximum(0, np.minimum(needed - 1, np.floor(needed * share).astype(np.int64)))


def _share(n: int) -> float:
    """L / T by the rule of DivideSkip, for n records."""
    return 1 / (MU * math.log2(max(n, 2)) + 1)


def _in_order(record: np.ndarray, code: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, weight): each record's shingles by how frequent they are, then by code; the same order everywhere."""
    weight = np.zeros(len(code), np.int64)
    if len(table):
        common = table[:, 0].astype(np.uint64)
        at = np.minimum(np.searchsorted(common, code), len(common) - 1)
        hit = common[at] == code
        weight[hit] = table[at[hit], 1]
    return np.lexsort((code, weight, record)), weight


def _level(size: np.ndarray) -> np.ndarray:
    """How often a record's sketch is doubled."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / (_SKETCH * 0.75))), 0, _LEVELS).astype(np.int64)


def _sketches(size: np.ndarray, record: np.ndarray, code: np.ndarray) -> list[bytes]:
    """A bit for each shingle, by its code; where two sketches differ, so do the sets."""
    level = _level(size)
    out: list[bytes] = [b""] * len(size)
    for v in np.unique(level[size > 0]):
        docs = np.flatnonzero((level == v) & (size > 0))
        row = np.full(len(size), -1, np.int64)
        row[docs] = np.arange(len(docs))
        bits = _SKETCH << int(v)
        for part in range(0, len(docs), max(1, 50_000_000 // bits)):
            some = docs[part : part + max(1, 50_000_000 // bits)]
            mine = (row[record] >= part) & (row[record] < part + len(some))
            table = np.zeros((len(some), bits), bool)
            table[row[record[mine]] - part, (code[mine] >> np.uint64(20)) % np.uint64(bits)] = True
            for d, line in zip(some, np.packbits(table, axis=1, bitorder="little"), strict=True):
                out[d] = line.tobytes()
    return out


def _post(frequent, least: Fraction, buckets: int, share: float, step: int):
    """Sends a row for each record and, per bucket, the postings of the short lists packed in one row.

    A posting is a shingle's code; its two lowest bits tell the side of a pair of segments, 0 in a list of one piece.
    """

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = frequent.value
        turn = 0
        for batch in batches:
            for rows in _blocks(batch):
                kinds = rows["kind"].tolist()
                record, code = shingles(kinds, rows["text"].tolist())
                size = np.bincount(record, minlength=len(rows))
                end = np.cumsum(size)
                sig = np.array([_signature(code[b - s : b]) if s else 0 for s, b in zip(size, end, strict=True)], np.int64)
                yield pd.DataFrame(
                    {
                        "bucket": (turn + np.arange(len(rows))) % buckets,
                        "kind": rows["kind"],
                        "key": rows["key"],
                        "version": rows["version"],
                        "sig": sig,
                        "size": size,
                        "copy": [_copy(t) for t in rows["text"]],
                        "blob": None,
                    }
                )
                turn += 1
                sketch = _sketches(size, record, code)
                # identical records post once
                _, first = np.unique(sig, return_index=True)
                chosen = np.zeros(len(rows), bool)
                chosen[first] = True
                chosen &= size > 0
                mine = chosen[record]
                record, code = record[mine], code[mine]
                order, weight = _in_order(record, code, table)
                record, code, weight = record[order], code[order], weight[order]
                sizes = np.where(chosen, size, 0)
                place = np.arange(len(code)) - (np.cumsum(sizes) - sizes)[record]
                near = place < size[record] - _set_aside(size[record], least, share)
                record, token, parts = record[near], code[near] & ~np.uint64(3), -(-weight[near] * step // SEGMENT)
                long = np.flatnonzero(parts > 1)
                if len(long):
                    # a record of a long list goes to each pair of segments that has its own
                    times = parts[long]
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(long, times)
                    own = sig[record[at]].astype(np.uint64) % parts[at].astype(np.uint64)
                    low, high = np.minimum(own, other.astype(np.uint64)), np.maximum(own, other.astype(np.uint64))
                    with np.errstate(over="ignore"):
                        cut = _mix(_mix(token[at] + low) + high) & ~np.uint64(3)
                    cut |= np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.uint64)
                    rest = parts <= 1
                    record, token = np.concatenate([record[rest], record[at]]), np.concatenate([token[rest], cut])
                bucket = ((token >> np.uint64(2)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((record, bucket))
                bucket, record, token = bucket[order], record[order], token[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                packed = []
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    docs, n = np.unique(record[part], return_counts=True)
                    head = np.zeros(len(docs), _DOC)
                    head["sig"], head["size"], head["n"] = sig[docs], size[docs], n
                    packed.append((b, None, None, None, 0, len(docs), 0, head.tobytes() + b"".join([sketch[d] for d in docs]) + token[part].tobytes()))
                if packed:
                    yield pd.DataFrame(packed, columns=["bucket", "kind", "key", "version", "sig", "size", "copy", "blob"])

    return post


def _merge(least: Fraction):
    """Merges the short lists of a bucket: passes record rows on (other naming the text) and adds, for the retained pairs, how often they occur together here (kind null, sig < other, size)."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, bodies, sketches = [], [], []
        for batch in batches:
            record = batch["blob"].isna()
            if record.any():
                yield batch[record].rename(columns={"copy": "other"})[["kind", "key", "version", "sig", "size", "other"]]
            for n, blob in zip(batch["size"][~record], batch["blob"][~record], strict=True):
                head = np.frombuffer(blob, _DOC, n)
                ends = head.nbytes + np.cumsum((_SKETCH // 8) << _level(head["size"]))
                sketches += [blob[a:b] for a, b in zip([head.nbytes, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                heads.append(head)
                bodies.append(np.frombuffer(blob, np.uint64, offset=int(ends[-1])))
        if not heads:
            return
        head, token = np.concatenate(heads), np.concatenate(bodies)
        sig, first, inverse = np.unique(head["sig"], return_index=True, return_inverse=True)
        size = np.zeros(len(sig), np.int64)
        size[inverse] = head["size"]
        doc = np.repeat(inverse, head["n"])
        del heads, bodies
        level = _level(size)
        slot = np.zeros(len(sig), np.int64)
        tables = {}
        for v in np.unique(level):
            mine = np.flatnonzero(level == v)
            slot[mine] = np.arange(len(mine))
            tables[int(v)] = np.frombuffer(b"".join([sketches[first[d]] for d in mine]), np.uint64).reshape(len(mine), -1)
        del sketches

        def alike(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
            """Whether the sketches differ in at most so many bits; a longer sketch is folded to the shorter one's length."""
            ok = np.zeros(len(x), bool)
            pair = level[x] * (_LEVELS + 1) + level[y]
            for both in np.unique(pair):
                at = np.flatnonzero(pair == both)
                for part in range(0, len(at), 500_000):
                    some = at[part : part + 500_000]
                    s, t = tables[int(both) // (_LEVELS + 1)][slot[x[some]]], tables[int(both) % (_LEVELS + 1)][slot[y[some]]]
                    while s.shape[1] != t.shape[1]:
                        if s.shape[1] > t.shape[1]:
                            s = s[:, : s.shape[1] // 2] | s[:, s.shape[1] // 2 :]
                        else:
                            t = t[:, : t.shape[1] // 2] | t[:, t.shape[1] // 2 :]
                    ok[some] = np.bitwise_count(s ^ t).sum(1, dtype=np.int64) <= most[some]
            return ok

        side, token = (token & np.uint64(3)).astype(np.int8), token >> np.uint64(2)
        order = np.lexsort((doc, size[doc], token))
        side, token, doc = side[order], token[order], doc[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        side, token, doc = side[keep], token[keep], doc[keep]
        length = size[doc]
        p, q = least.numerator, least.denominator
        here = np.flatnonzero(token[1:] == token[:-1])
        step, found, held = 1, [], 0
        while here.size:
            there = here + step
            ok = there < len(token)
            here, there = here[ok], there[ok]
            # lists are ordered by size: beyond size / t no later entry can qualify
            ok = (token[here] == token[there]) & (length[here] * q >= length[there] * p)
            here, there = here[ok], there[ok]
            met = (side[here] == 0) | (side[here] != side[there])
            x, y = doc[here[met]], doc[there[met]]
            both = size[x] + size[y]
            close = alike(x, y, both - 2 * -(-p * both // (p + q)))
            if close.any():
                x, y = x[close], y[close]
                found.append(np.minimum(x, y) * len(sig) + np.maximum(x, y))
                held += len(found[-1])
                if held > 4_000_000:
                    yield _counted(sig, found)
                    found, held = [], 0
            step += 1
        if found:
            yield _counted(sig, found)

    return merge


def _counted(sig: np.ndarray, found: list[np.ndarray]) -> pd.DataFrame:
    code, n = np.unique(np.concatenate(found), return_counts=True)
    return pd.DataFrame({"kind": None, "key": None, "version": None, "sig": sig[code // len(sig)], "size": n, "other": sig[code % len(sig)]})


def _latest(records: DataFrame) -> DataFrame:
    """(key, kind, sig, size, copy) of the newest version of each key; the narrow rows are aggregated, texts never move for this."""
    newest = F.max_by(F.struct("sig", "size", F.col("other").alias("copy")), F.coalesce("version", F.lit(float("-inf")))).alias("s")
    return records.groupBy("kind", "key").agg(newest).select("kind", "key", "s.sig", "s.size", "s.copy").where("size > 0")


_LISTED = "sig long, codes binary, short int, cut_weight long, cut_code long"
#: Roles of a row of the probing: a class's codes for the lists, a pair's count, a pair's probes.
_LIST, _COUNT, _ASKED = 0, 1, 2
_PROBE = "bucket int, role int, sig long, other long, n long, whole long, tokens binary"


def _ask(buckets: int):
    """Packs, per bucket, the codes of a class for its lists, or of a pair's first class beyond the cut for probing; the pair's count goes along once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                codes = np.frombuffer(r.codes, np.uint64)[r.start :]
                if r.role == _ASKED:
                    rows.append((r.sig % buckets, _COUNT, r.sig, r.other, r.n, r.whole, None))
                bucket = codes % np.uint64(buckets)
                rows.extend((int(b), r.role, r.sig, r.other, 0, r.whole, codes[bucket == b].tobytes()) for b in np.unique(bucket))
            yield pd.DataFrame(rows, columns=["bucket", "role", "sig", "other", "n", "whole", "tokens"])

    return ask


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sig, other, n, whole): of each pair, the count that came along and how many of its probes the lists of a bucket answer."""
    lists, probes = [], []
    for batch in batches:
        if (told := batch["role"] == _COUNT).any():
            yield batch.loc[told, ["sig", "other", "n", "whole"]]
        for to, role in ((lists, _LIST), (probes, _ASKED)):
            part = batch[batch["role"] == role]
            if len(part):
                tokens = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
                to.append((part["sig"].to_numpy(np.int64), part["other"].to_numpy(np.int64), part["whole"].to_numpy(np.int64), np.array([len(t) for t in tokens]), np.concatenate(tokens)))
    if not lists or not probes:
        return
    owner, _, _, n, token = (np.concatenate(x) for x in zip(*lists, strict=True))
    names, owner = np.unique(owner, return_inverse=True)
    listed, token = np.unique(token, return_inverse=True)
    # inverted lists one after the other, each in order of its owners
    entries = np.unique(token * len(names) + np.repeat(owner, n))
    sig, other, whole, n, token = (np.concatenate(x) for x in zip(*probes, strict=True))
    at = np.minimum(np.searchsorted(listed, token), len(listed) - 1)
    who = np.minimum(np.searchsorted(names, other), len(names) - 1)
    wanted = at * len(names) + np.repeat(who, n)
    place = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
    hit = (entries[place] == wanted) & (listed[at] == token) & np.repeat(names[who] == other, n)
    yield pd.DataFrame({"sig": sig, "other": other, "n": np.bincount(np.repeat(np.arange(len(n)), n), hit, len(n)).astype(np.int64), "whole": whole})


def similar_classes(records: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same shingles, and links between classes.

    records has ``kind`` ('w5': five words, 'c3': three characters), ``key``, ``version`` and ``text``; of rows with
    the same kind and key the newest counts. Returns (kind, key, sig, size, copy) of every record with at least
    one shingle, sig naming its class and copy its text, and (sig, other, shared, total) with sig < other of every pair of
    classes with shared / total >= threshold. Only records of one kind are compared.
    Records without shingles (null, empty or short texts) are similar to none.

    A posting takes 8 bytes and each bucket that a record has postings in 48 more (16 and its sketch), so at most 56 bytes a posting
    move, however many buckets there are. The probes move the codes of those classes only that are in a retained pair.
    """
    spark = records.sparkSession
    least = Fraction(threshold).limit_denominator(1000)
    records = records.select("kind", F.col("key").cast("string").alias("key"), F.col("version").cast("double").alias("version"), "text").where("key is not null")
    n = records.count()
    share = _share(n)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_RECORDS)
    frequent = spark.sparkContext.broadcast(_learn_order(records, n))
    step = max(1, n // ORDER_SAMPLE)
    sent = records.mapInPandas(_post(frequent, least, buckets, share, step), _SENT).repartitionById(buckets, F.col("bucket"))
    merged = cut_lineage(sent.mapInPandas(_merge(least), "kind string, key string, version double, sig long, size int, other long"))
    members = cut_lineage(_latest(merged.where("kind is not null")))
    # superseded versions posted too; a pair stands if both classes still have a member
    classes = members.groupBy("sig").agg(F.min(F.struct("kind", "key")).alias("r"), F.max("size").alias("size")).select("sig", "r.kind", "r.key", "size")
    p, q = least.numerator, least.denominator

    def aside(size: str):
        needed = F.ceil(F.lit(p) * F.col(size) / q)
        return F.greatest(F.lit(0), F.least(needed - 1, F.floor(needed * share)))

    pairs = merged.where("kind is null").groupBy("sig", "other").agg(F.sum("size").alias("n"))
    pairs = pairs.join(classes.select("sig", F.col("size").alias("a")), "sig").join(classes.select(F.col("sig").alias("other"), F.col("size").alias("b")), "other")
    pairs = pairs.where(F.col("n") >= F.ceil(F.lit(p) * (F.col("a") + F.col("b")) / (p + q)) - F.greatest(aside("a"), aside("b")))
    pairs = cut_lineage(pairs.select("sig", "other", "n", (F.col("a") + F.col("b")).cast("long").alias("whole")))
    needed = pairs.select("sig").union(pairs.select("other")).distinct()
    wanted = classes.join(needed, "sig").select("kind", "key", F.col("sig").alias("class"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _blocks(batch):
                record, code = shingles(rows["kind"].tolist(), rows["text"].tolist())
                order, weight = _in_order(record, code, frequent.value)
                cuts = np.searchsorted(record, np.arange(len(rows) + 1))
                aside_ = _set_aside(np.diff(cuts), least, share)
                out = []
                for c, a, b, long in zip(rows["class"], cuts[:-1], cuts[1:], aside_, strict=True):
                    if _signature(code[a:b]) == c:
                        mine, short = order[a:b], b - a - long
                        last = mine[short - 1]
                        out.append((c, code[mine].tobytes(), short, weight[last], int(code[last].astype(np.int64))))
                yield pd.DataFrame(out, columns=["sig", "codes", "short", "cut_weight", "cut_code"])

    # a short list of the classes in retained pairs goes to the texts, else the texts go to it
    wanted = cut_lineage(wanted)
    if wanted.agg(F.coalesce(F.sum(F.length("key") + 40), F.lit(0))).first()[0] <= LIST_BYTES:
        wanted = F.broadcast(wanted)
    codes = records.join(wanted, ["kind", "key"]).select("kind", "text", "class").mapInPandas(listed, _LISTED)
    codes = cut_lineage(codes.dropDuplicates(["sig"]))
    # the merge counted up to the earlier of the two cuts; the probes begin after it, in the codes of the class that has it
    at = F.struct("cut_weight", (F.col("cut_code").bitwiseXOR(F.lit(-(2**63)))).alias("c"))
    cut = codes.select("sig", at.alias("cut"))
    first = pairs.join(cut, "sig").join(cut.select(F.col("sig").alias("other"), F.col("cut").alias("cut2")), "other")
    swapped = F.col("cut2") < F.col("cut")
    asked = first.select(F.when(swapped, F.col("other")).otherwise(F.col("sig")).alias("sig"), F.when(swapped, F.col("sig")).otherwise(F.col("other")).alias("other"), "n", "whole")
    asked = asked.join(codes.select("sig", "codes", F.col("short").alias("start")), "sig").select("sig", "other", "n", "whole", "codes", "start")
    zero = F.lit(0).cast("long")
    flow = asked.withColumn("role", F.lit(_ASKED)).unionByName(codes.select("sig", zero.alias("other"), zero.alias("n"), zero.alias("whole"), "codes", F.lit(0).alias("start"), F.lit(_LIST).alias("role")))
    hits = flow.mapInPandas(_ask(buckets), _PROBE).repartitionById(buckets, F.col("bucket")).mapInPandas(_probe, "sig long, other long, n long, whole long")
    shared = hits.groupBy(F.least("sig", "other").alias("sig"), F.greatest("sig", "other").alias("other"), "whole").agg(F.sum("n").cast("int").alias("shared"))
    links = shared.select("sig", "other", "shared", (F.col("whole") - F.col("shared")).cast("int").alias("total"))
    return members, links.where(F.col("shared") * q >= F.col("total") * p)


def similar_pairs(records: DataFrame, threshold: float = 0.8, expand: int | None = EXPAND) -> DataFrame:
    """(node_a, node_b), node_a < node_b, of records with shared / total >= threshold; see similar_classes.

    Of more than ``expand`` exact copies of one text each is linked to their representative, which alone stands for them
    towards other texts; None lists every pair of copies too.
    """
    members, links = similar_classes(records, threshold)
    copies = members.groupBy("sig", "copy").agg(F.count("*").alias("n"), F.min("key").alias("head"))
    members = members.join(copies, ["sig", "copy"]).select("sig", "key", "n", "head")
    many = F.col("n") > expand if expand is not None else F.lit(False)
    speaking = members.where(~many | (F.col("key") == F.col("head"))).select("sig", "key")
    # a class of any size gives all its pairs; one side of a large class is spread over several tasks
    sizes = speaking.groupBy("sig").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    second = speaking.join(sizes, "sig").select(F.col("sig").alias("other"), F.col("key").alias("key2"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    meets = links.select("sig", "other").join(sizes.withColumnRenamed("sig", "other"), "other").select("sig", "other", spread)
    across = meets.join(speaking, "sig").join(second, ["other", "part"]).select("key", "key2")
    first = speaking.join(sizes, "sig").select(F.col("sig").alias("other"), "key", spread)
    within = first.join(second, ["other", "part"]).where("key < key2").select("key", "key2")
    star = members.where(many & (F.col("key") != F.col("head"))).select(F.col("head").alias("key"), F.col("key").alias("key2"))
    pairs = across.unionByName(within).unionByName(star)
    return pairs.select(F.least("key", "key2").alias("node_a"), F.greatest("key", "key2").alias("node_b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node reachable, by alternating large and small stars until nothing changes."""
    both = edges.select("a", "b").where("a <> b")
    state = cut_lineage(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    changed = True
    while changed:
        two = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut_lineage(new)
        changed = new.exceptAll(state).limit(1).count() or state.exceptAll(new).limit(1).count()
        state = new
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())


def similar_groups(records: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(kind, key, sig, group, n_copies, n_links) of every record: group joins all records that links reach, named by its smallest key; n_copies counts the records of its class, n_links the classes it is linked to."""
    members, links = similar_classes(records, threshold)
    links = cut_lineage(links.select("sig", "other"))
    joined = components(links.select(F.col("sig").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("sig"), "component")
    degree = links.select("sig").union(links.select("other")).groupBy("sig").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("sig").agg(F.count("*").alias("n_copies"), F.min("key").alias("first"))
    of_class = copies.join(joined, "sig", "left").join(degree, "sig", "left").select("sig", F.coalesce("component", "sig").alias("component"), "n_copies", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = of_class.groupBy("component").agg(F.min("first").alias("group"))
    of_class = of_class.join(names, "component").select("sig", "group", "n_copies", "n_links")
    return members.select("kind", "key", "sig").join(of_class, "sig").select("kind", "key", "sig", "group", "n_copies", "n_links")
