"""A positional index of texts, and searches that read it and no text.

A row is a token of a document with its positions in order.  Rows are range-partitioned and sorted by token, then
document: the tokens that a query names, or that begin as its prefix does, lie side by side, so file and page
statistics leave the rest unread, and a very common token is spread over many files.

A search selects the lists it needs in one scan and brings them together by document in one exchange.  Documents are
indexed whole, or capped (``search.cap``), so that the rows of one are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.query import Operand, parse
from ..tables import settled, sweep, write, written
from .search import WEIGHTS, cap, tokens

#: What names a document in the index.
KEY = ["source_kind", "id", "source_row"]
#: What a cover counts, before its gaps divide it.
COVER = 0.1
#: Fixed values of snippets: fragments, words of one, segments and characters of all.
FRAGMENTS, WORDS, SEGMENTS, CHARACTERS = 2, 35, 32, 4_000

#: Parts of an index of whole texts.
WAVES = 4

_PLACE = 1 << 32


def build(documents: DataFrame, whole: bool = False, waves: int = 1) -> DataFrame:
    """(source_kind, id, source_row, token, positions) of documents (KEY, text), capped unless ``whole``.  ``waves``: of how
    many parts of an index this is one, each with its share of the session's partitions.

    A null text is an empty one and has no rows; a repeated document has each position twice.  Texts are read once: a
    document's lists are made where it is read, written down, and then dealt to ranges of tokens.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(*KEY, tokens(text if whole else cap(text)).alias("words"))
    kinds = "source_kind string, id long, source_row long, token string, positions array<int>"
    lists = settled(words.mapInArrow(_listed, kinds))
    order = ["token", *KEY]
    repeated = settled(documents.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in KEY]))
    if not repeated.isEmpty():  # only their lists are brought together
        same = _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
        joined = lists.join(repeated, same, "left_semi").groupBy(*order).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        lists = lists.join(repeated, same, "left_anti").unionByName(joined)
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // waves)
    return lists.repartitionByRange(parts, *order).select(*KEY, "token", "positions").sortWithinPartitions(*order)


def write_whole(documents: DataFrame, to: str) -> None:
    """Writes the index of whole texts in WAVES parts by document, one after another: of the lists and what is exchanged only
    a part lies on disk at once."""
    spark = documents.sparkSession
    for wave in range(WAVES):
        since = written(spark)
        some = documents.where(F.pmod(F.xxhash64(*KEY), F.lit(WAVES)) == wave)
        write(build(some, whole=True, waves=WAVES), f"{to}/wave={wave}")
        sweep(spark, since)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of each word of each row (KEY, words), some rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            words = batch.column("words")
            counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten().dictionary_encode()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            key = row * len(flat.dictionary) + flat.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            edges = pa.array(np.append(first, len(key)).astype(np.int32))
            positions = pa.ListArray.from_arrays(edges, pa.array(pos[order].astype(np.int32)))
            own = pa.array(key[first] // len(flat.dictionary))
            token = flat.dictionary.take(pa.array(key[first] % len(flat.dictionary)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in KEY), token, positions], [*KEY, "token", "positions"])


@dataclass(frozen=True)
class Plan:
    """A query as the index sees it: every distinct lexeme test is a slot, operands are lists of slots."""

    slots: tuple[tuple[str, bool], ...]  # (lexeme, whether a prefix)
    operands: tuple[tuple[int, ...], ...]  # slots in order; more than one stand next to each other
    branches: tuple[tuple[tuple[int, ...], tuple[tuple[int, ...], ...]], ...]  # operands that must be; lists that must not be whole

    @property
    def wanted(self) -> list[int]:
        """Operands that are asked for in some branch."""
        return sorted({k for have, _ in self.branches for k in have})

    @property
    def unwanted(self) -> list[int]:
        return sorted({k for _, lack in self.branches for group in lack for k in group})


def compile(query: str | list[list[Operand]]) -> Plan:
    """Operands of several lexemes that are no phrase count as one operand a lexeme."""
    slots: dict[tuple[str, bool], int] = {}
    operands: dict[tuple[int, ...], int] = {}
    branches = []
    for branch in parse(query) if isinstance(query, str) else query:
        have: list[int] = []
        lack: list[tuple[int, ...]] = []
        for operand in branch:
            groups = [operand.lexemes] if operand.phrase else [[x] for x in operand.lexemes]
            keys = [tuple(slots.setdefault((x, operand.prefix and len(groups) == 1), len(slots)) for x in group) for group in groups]
            numbers = tuple(operands.setdefault(key, len(operands)) for key in keys)
            if operand.excluded:
                lack.append(numbers)
            else:
                have.extend(numbers)
        branches.append((tuple(dict.fromkeys(have)), tuple(lack)))
    return Plan(tuple(slots), tuple(operands), tuple(branches))


def _is(token: Column, slot: tuple[str, bool]) -> Column:
    lexeme, prefix = slot
    return token.startswith(lexeme) if prefix else token == lexeme


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _lists(index: DataFrame, plan: Plan, slots: list[int]) -> DataFrame:
    """Lists of the tokens that fit any of ``slots``."""
    return index.where(_any([_is(F.col("token"), plan.slots[s]) for s in slots]))


def _fulfilled(plan: Plan, has: list[Column]) -> Column:
    """Whether some branch holds, by the operands that a document has."""
    return _any([_all([*(has[k] for k in have), *(~_all([has[k] for k in group]) for group in lack)]) for have, lack in plan.branches])


def match(index: DataFrame, query: str | list[list[Operand]]) -> DataFrame:
    """The documents (KEY) that fulfil the query.  Positions are read only where it has a phrase."""
    plan = compile(query)
    if any(len(o) > 1 for o in plan.operands):
        rows = _placed(index, plan)
        has = [F.max(F.coalesce(F.col(f"_e{k}") > 0, F.lit(False))) for k in range(len(plan.operands))]
    else:
        rows = _lists(index, plan, list(range(len(plan.slots))))
        has = [F.bool_or(_is(F.col("token"), plan.slots[o[0]])) for o in plan.operands]
    found = rows.groupBy(*KEY).agg(*[h.alias(f"_h{k}") for k, h in enumerate(has)])
    return found.where(_fulfilled(plan, [F.col(f"_h{k}") for k in range(len(has))])).select(*KEY)


def _placed(index: DataFrame, plan: Plan) -> DataFrame:
    """A row a position of any slot: KEY, pos, ``_n`` (how many positions asked for there are up to it) and, for every
    operand that ends there, ``_e<k>``: where it starts, as position and such a number in one."""
    rows = _lists(index, plan, list(range(len(plan.slots))))
    flags = [_is(F.col("token"), s).alias(f"_s{i}") for i, s in enumerate(plan.slots)]
    every = rows.select(*KEY, F.explode(F.array_distinct("positions")).alias("pos"), *flags)
    order = Window.partitionBy(*KEY).orderBy("pos")
    asked = _any([F.col(f"_s{s}") for k in plan.wanted for s in plan.operands[k]])
    every = every.withColumn("_n", F.sum(asked.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    for k, slots in enumerate(plan.operands):
        ends = F.col(f"_s{slots[-1]}")
        for back, slot in enumerate(reversed(slots[:-1]), 1):
            ends = ends & (F.lag("pos", back).over(order) == F.col("pos") - back) & F.lag(f"_s{slot}", back).over(order)
        start = (F.col("pos").cast("long") - len(slots) + 2) * _PLACE + F.col("_n") - len(slots) + 1
        every = every.withColumn(f"_e{k}", F.when(ends, start))
    return every.select(*KEY, "pos", "_n", *[f"_e{k}" for k in range(len(plan.operands))])


def covers(index: DataFrame, query: str | list[list[Operand]]) -> DataFrame:
    """(KEY, first, last, gaps): the shortest stretches of matching documents that hold a whole branch.

    A stretch ends where one of its operands ends and begins as late as it can; none holds another.  ``gaps`` are
    its words that no operand asked for.  Branches that a document does not fulfil, for a word it must not have, count not.
    """
    plan = compile(query)
    rows = _placed(index, plan)
    whole = Window.partitionBy(*KEY)
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_x{k}": F.max(f"_e{k}").over(whole).isNotNull() for k in plan.unwanted})
    rows = rows.withColumns({f"_l{k}": F.max(f"_e{k}").over(upto) for k in plan.wanted})
    begins = []
    for have, lack in plan.branches:
        some = [F.col(f"_l{k}") for k in have]
        begin = F.least(*some) if len(some) > 1 else some[0]
        fits = _all([*(c.isNotNull() for c in some), *(~_all([F.col(f"_x{k}") for k in group]) for group in lack)])
        begins.append(F.when(fits, begin))
    rows = rows.withColumn("_b", F.greatest(*begins) if len(begins) > 1 else begins[0])
    new = F.col("_b") > F.coalesce(F.lag("_b").over(whole.orderBy("pos")), F.lit(-1))
    first = F.floor(F.col("_b") / _PLACE) - 1
    gaps = (F.col("pos") - first) - (F.col("_n") - F.pmod(F.col("_b"), F.lit(_PLACE)))
    return rows.withColumn("_new", new).where("_new").select(*KEY, first.cast("int").alias("first"), F.col("pos").cast("int").alias("last"), gaps.cast("int").alias("gaps"))


def ranked(index: DataFrame, query: str | list[list[Operand]]) -> DataFrame:
    """(KEY, score) of matching documents: r / (1 + r) times the weight of their kind, r the sum of COVER / (1 + gaps) over
    their covers."""
    by_gaps = covers(index, query).groupBy(*KEY, "gaps").agg(F.count("*").alias("n"))
    # added from the smallest gaps on, so that equal documents have equal sums
    terms = F.array_sort(F.collect_list(F.struct("gaps", "n")))
    r = F.aggregate(F.col("_t"), F.lit(0.0), lambda s, x: s + x["n"] * F.lit(COVER) / (x["gaps"] + 1))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("source_kind"))
    summed = by_gaps.groupBy(*KEY).agg(terms.alias("_t")).withColumn("_r", r)
    return summed.select(*KEY, (F.col("_r") / (F.col("_r") + 1) * weight).alias("score"))


def fragments(index: DataFrame, keys: DataFrame, query: str | list[list[Operand]]) -> DataFrame:
    """(KEY, spans): for documents ``keys`` (a page of them) the FRAGMENTS stretches to show, in order of the text.

    The best cover has the fewest gaps and comes first in the text; the second is the next best beyond the words
    that the first one's fragment shows.  A fragment has WORDS words, the cover in its middle, where the text has them.
    """
    plan = compile(query)
    some = _lists(index, plan, list(range(len(plan.slots)))).join(F.broadcast(keys.select(*KEY).distinct()), KEY, "left_semi")
    found = covers(some, query)
    best = Window.partitionBy(*KEY).orderBy("gaps", "first", "last")
    held = found.withColumn("_lead", F.first(F.struct("first", "last")).over(best))
    edge = lambda c: F.greatest(F.lit(0), c["first"] - _pad(c))
    lead_from, lead_to = edge(F.col("_lead")), edge(F.col("_lead")) + WORDS - 1
    beyond = (F.col("first") > lead_to) | (F.col("last") < lead_from)
    second = F.min(F.when(beyond, F.struct("gaps", "first", "last")))
    two = held.groupBy(*KEY, "_lead").agg(second.alias("_next"))
    lo, hi = lead_from, lead_to
    nxt = F.col("_next")
    next_lo = F.greatest(F.lit(0), nxt["first"] - _pad(nxt))
    next_hi = next_lo + WORDS - 1
    behind = nxt["first"] > hi
    other = F.struct(
        F.when(behind, F.greatest(next_lo, hi + 1)).otherwise(next_lo).alias("lo"), F.when(behind, next_hi).otherwise(F.least(next_hi, lo - 1)).alias("hi")
    )
    spans = F.when(nxt.isNull(), F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(
        F.array_sort(F.array(F.struct(lo.alias("lo"), hi.alias("hi")), other))
    )
    return two.select(*KEY, spans.alias("spans"))


def _pad(cover: Column) -> Column:
    """Words shown before a cover: half of what it leaves of WORDS."""
    return F.greatest(F.lit(0), F.floor((F.lit(WORDS) - (cover["last"] - cover["first"] + 1)) / 2).cast("int"))


def snippet(text: Column, spans: Column, query: str | list[list[Operand]]) -> Column:
    """Segments (text, highlighted) of the fragments of a capped ``text``: its words as they stand, with what follows each.

    More than SEGMENTS, or more than CHARACTERS of them, make one segment without a highlight, cut there.
    """
    plan = compile(query)
    asked = sorted({s for k in plan.wanted for s in plan.operands[k]})
    word = r"[\p{L}\p{M}\p{Nd}]+"
    pieces = F.regexp_extract_all(cap(F.coalesce(text, F.lit(""))), F.lit(rf"({word})([^\p{{L}}\p{{M}}\p{{Nd}}]*)"), F.lit(0))

    def one(piece: Column) -> Column:
        token = F.regexp_extract(piece, word, 0)
        lit = _any([_is(F.lower(token), plan.slots[s]) for s in asked])
        rest = F.regexp_replace(piece, f"^{word}", "")
        return F.array(F.struct(token.alias("text"), lit.alias("highlighted")), F.struct(rest.alias("text"), F.lit(False).alias("highlighted")))

    shown = F.flatten(F.transform(spans, lambda s: F.slice(pieces, s["lo"] + 1, F.greatest(F.lit(0), s["hi"] - s["lo"] + 1))))
    flat = F.filter(F.flatten(F.transform(shown, one)), lambda s: s["text"] != "")

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & ~s["highlighted"] & ~F.coalesce(F.when(F.size(out) > 0, last["highlighted"]), F.lit(True))
        joined = F.struct(F.concat(last["text"], s["text"]).alias("text"), F.lit(False).alias("highlighted"))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    kind = "array<struct<text:string,highlighted:boolean>>"
    merged = F.aggregate(flat, F.array().cast(kind), add)
    plain = F.array_join(F.transform(flat, lambda s: s["text"]), "")
    over = (F.size(merged) > SEGMENTS) | (F.length(plain) > CHARACTERS)
    return F.when(over, F.array(F.struct(F.substring(plain, 1, CHARACTERS).alias("text"), F.lit(False).alias("highlighted")))).otherwise(merged)


def stored(spark: SparkSession, at: str) -> DataFrame:
    """An index that was written to ``at``."""
    kinds = "source_kind string, id long, source_row long, token string, positions array<int>"
    return spark.read.schema(kinds).parquet(at)
