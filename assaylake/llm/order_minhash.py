"""Order MinHash fingerprints of texts, in DataFrame functions alone.

The tokens of a text are its words, cut at eight characters; its k-mers are pairs of neighbouring tokens, each
numbered by how often the pair has occurred before. A hash of (k-mer, number) puts the k-mers on a circle; 64
slots begin at equal distances on it. Each slot selects the two k-mers that follow its begin, which are the least
ones of a hash counted from there, puts them back into the order of the text, and hashes them as a tuple. A short text leaves arcs
between slots empty; such a slot goes on to the next k-mers, so every tuple has its two k-mers, and an order, at
every length. Two texts agree in a slot if they select the same k-mers there in the same order, so the share of
agreeing slots falls both with replaced and with reordered passages, as an edit distance does.

Hashes and positions travel packed in one long (33 bits of hash, 31 bits of position, more than a text has), which
sorts fast. Hashes that fall together in 33 bits only number two k-mers as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, unused

TOKEN = r"[^\x20\x09-\x0D]{1,8}"
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
POSITION_BITS = 31
HASH_DIGITS = 4
#: Ranges of the id for each shuffle partition.
RANGES_PER_PARTITION = 2
_POSITIONS = (1 << POSITION_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once; inside a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR(position.cast("long"))


def _hash_part(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _arc(packed: Column) -> Column:
    """The arc between two slots on which a k-mer lies, from 0 in the order of signed numbers."""
    return (F.shiftright(packed, 64 - SLOT_BITS) + SLOTS // 2).cast("int")


def _kmers(tokens: Column) -> Column:
    """Packed hashes of the pairs of neighbours; a single token counts as a pair with nothing."""
    head = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1)))
    return F.transform(head, lambda x, i: _packed(F.xxhash64(x, F.get(tokens, i + 1)), i))


def _numbered(kmers: Column) -> Column:
    """Packed hashes of (k-mer, how often it occurred before), sorted: the runs of equal k-mers number themselves."""

    def runs(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda j: (j == 0) | (_hash_part(F.get(rows, j)) != _hash_part(F.get(rows, j - 1))))

        def number(at: Column) -> Column:
            def run(start: Column, r: Column) -> Column:
                return F.transform(F.slice(rows, start + 1, F.coalesce(F.get(at, r + 1), F.size(rows)) - start), lambda x, occurrence: _packed(F.xxhash64(_hash_part(x), occurrence), x.bitwiseAND(F.lit(_POSITIONS))))

            return F.flatten(F.transform(at, run))

        return F.when(F.size(rows) > 0, _let(starts, number)).otherwise(rows)

    return F.sort_array(_let(F.sort_array(kmers), runs))


def _slots(numbered: Column) -> Column:
    """The hash of the tuple of each slot, from k-mers in the order of the circle; empty without a k-mer."""

    def select(rows: Column) -> Column:
        n = F.size(rows)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (_arc(F.get(rows, j)) != _arc(F.get(rows, j - 1))))

        def hashed(j: Column) -> Column:
            def of(pair: Column) -> Column:
                x, y = pair["x"], pair["y"]
                swap = y.bitwiseAND(F.lit(_POSITIONS)) < x.bitwiseAND(F.lit(_POSITIONS))
                tuple_hash = F.when(swap, F.xxhash64(_hash_part(y), _hash_part(x))).otherwise(F.xxhash64(_hash_part(x), _hash_part(y)))
                return tuple_hash.bitwiseAND(F.lit((1 << 4 * HASH_DIGITS) - 1)).cast("int")

            return _let(F.struct(F.get(rows, j).alias("x"), F.when(n > 1, F.get(rows, (j + 1) % n)).alias("y")), of)

        def spread(found: Column) -> Column:
            """Every slot up to that of a first k-mer's arc takes what begins there; those after the last go round."""
            filled = F.transform(found, lambda e, i: F.array_repeat(e["hash"], e["arc"] - F.coalesce(F.get(found, i - 1)["arc"], F.lit(-1))))
            return F.slice(F.concat(F.flatten(filled), F.array_repeat(F.get(found, F.lit(0))["hash"], SLOTS)), 1, SLOTS)

        return _let(F.transform(firsts, lambda j: F.struct(_arc(F.get(rows, j)).alias("arc"), hashed(j).alias("hash"))), spread)

    return _let(numbered, lambda rows: F.when(F.size(rows) > 0, select(rows)).otherwise(F.array().cast("array<int>")))


def signature(text: Column) -> Column:
    """The signature of a text: an int for each slot, in order; empty for a text without a word."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return _slots(_numbered(F.when(F.size(tokens) > 0, _let(tokens, _kmers)).otherwise(F.array().cast("array<bigint>"))))


def fingerprint(sig: Column) -> Column:
    """A signature as text: four hex digits for each slot."""
    return F.array_join(F.transform(sig, lambda e: F.lower(F.lpad(F.hex(e), HASH_DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the slots in which two signatures agree, 0 to 1; two empty signatures are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(same / SLOTS)


def _place(key: Column, tie: Column, bounds: list[int]) -> Column:
    """The range of (key, tie) among sorted ``bounds``, found by the roots of blocks, then inside a block. A key that is a bound
    r times has r ranges, over which its rows are spread in the order of their ties."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    roots = F.array(*(F.lit(b[-1]) for b in blocks))
    table = F.array(*(F.array(*(F.lit(x) for x in b)) for b in blocks))
    below = _let(F.size(F.filter(roots, lambda b: b < key)), lambda k: F.least(k * step, F.lit(len(bounds))) + F.coalesce(F.size(F.filter(F.get(table, k), lambda b: b < key)), F.lit(0)))
    often = {b: bounds.count(b) for b in {x for x, y in zip(bounds, bounds[1:], strict=False) if x == y}}
    if not often:
        return below
    times = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in often.items() for x in kv)), key), F.lit(1))
    share = F.shiftrightunsigned(F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 32) * times, 32)
    return below + share.cast("int")


def with_next(docs: DataFrame, id_col: str, tie_col: str, derived: dict[str, Column]) -> DataFrame:
    """``docs`` and ``derived`` columns, with ``next_<column>`` of all of them but the id from the next row by ascending
    id (ties by the hash of ``tie_col``); the first row follows the last. A null id comes first.

    The rows are dealt into ranges of the id by its quantiles, an id of many rows into several by the hash; the first row
    of each range also goes, as a sentinel, to the end of the range before it. So one shuffle of the rows is enough and
    only rows that are equal throughout stay together.
    """
    ranges = RANGES_PER_PARTITION * partitions(docs.sparkSession)
    own = unused(docs, "led_")
    key, tie, place, sentinel, first, to = (f"{own}{n}" for n in ("key", "tie", "range", "sentinel", "first", "to"))
    id_value = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    fractions = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(id_value, fractions, 10_000 if ranges < 1000 else 10 * ranges)).first()[0]
    placed = docs.withColumns({key: id_value, tie: F.xxhash64(tie_col)}).withColumn(place, _place(F.col(key), F.col(tie), sorted(found or [])).cast("int"))
    rank = F.col(key).cast("decimal(38,0)") * F.lit(1 << 48) + F.shiftright(F.col(tie), 16).cast("decimal(38,0)")  # (id, 48 bits of the hash) as one number
    order = Window.orderBy(place)  # at most one row for each range
    firsts = placed.groupBy(place).agg(F.min(rank).alias(first))
    firsts = firsts.select(first, F.coalesce(F.lag(place).over(order), F.max(place).over(Window.partitionBy())).alias(to))
    sentinels = placed.join(F.broadcast(firsts), rank == F.col(first)).dropDuplicates([to]).withColumn(place, F.col(to)).drop(first, to)
    both = placed.withColumn(sentinel, F.lit(False)).union(sentinels.withColumn(sentinel, F.lit(True)))
    within = Window.partitionBy(place).orderBy(sentinel, key, tie)
    both = both.withColumns(derived)
    columns = [c for c in (*docs.columns, *derived) if c != id_col]
    led = both.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns))
    return led.where(~F.col(sentinel)).drop(key, tie, place, sentinel)


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter is replaced by the start of the next document.

    :return: ``doc_id``, ``n_chars``, ``edited``, ``signature``, ``edited_signature``, ``next_signature``.

    Null texts count as empty. An empty text has an empty signature and stays empty when edited. Repeated rows
    follow each other. A single document follows itself. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    led = with_next(rows, "doc_id", "text", {"signature": signature(F.col("text"))})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    led = led.select("doc_id", n.cast("long").alias("n_chars"), "signature", "next_signature", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    return led.select("*", signature(F.col("edited")).alias("edited_signature"))
