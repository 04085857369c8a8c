"""Secret scans with corpus-wide ownership frequency (operator 10), in DataFrame functions only.

Base spans are the regular-expression matches of three kinds. The method then hashes every candidate value and counts the
distinct repositories (``source``) and owners of the corpus that hold it: a value that many owners hold is a copied
example, one that a single owner holds looks live. It adds spans for values that no base pattern tells: long mixed tokens
(``opaque``) whose value belongs to one owner, which generic patterns report only at the price of many false alarms.

Positions come from splitting: each match is wrapped in a mark, the text is split at the mark, so that every second part
is a match, and running lengths give the code points. The mark is first replaced by another control character in the
text; neither is in any pattern, and a position moves by nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, documents, stored, whole

# The patterns of the contract, by kind in the order in which kinds are listed.
ASSIGN = (
    r"(?i)((?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Added candidates: a whole token of 24 characters or more with a digit, a lower-case and an upper-case letter.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
MIXED = ("[0-9]", "[a-z]", "[A-Z]")
#: A value that this many owners hold, or more, is an example.
EXAMPLE_OWNERS = 3

#: Parts of a text that are gathered before they join the others.
RUN = 256
MARK, CUT, PLAIN = "\x01", "\x02", "\x03"


def _cells(marked: Column) -> Column:
    """Array of (part, start, end) for every second part of a marked text; CUT marks don't count as characters.

    An array grows by a copy, so parts are gathered in runs of RUN, and runs in the whole.
    """
    parts = F.split(marked, MARK, -1)
    none = F.array().cast("array<struct<part:string,start:int,end:int>>").alias("found")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part) - F.when(F.instr(part, CUT) > 0, 1).otherwise(0)
        hit = F.array(F.struct(part.alias("part"), acc["at"].alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), (acc["i"] + 1).alias("i"), F.when(acc["i"] % 2 == 1, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found")
        )

    def run(acc: Column, k: Column) -> Column:
        one = F.aggregate(F.slice(parts, k * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), acc["i"].alias("i"), none), step)
        return F.transform(F.array(one), lambda x: F.struct(x["at"].alias("at"), x["i"].alias("i"), F.concat(acc["found"], x["found"]).alias("found")))[0]

    whole_runs = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), start, run, lambda acc: acc["found"])
    return F.when(F.size(parts) <= RUN, F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(whole_runs)


def _matches(text: Column, pattern: str) -> Column:
    found = _cells(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"))
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def _spans(kind: str, found: Column, keep=None) -> Column:
    """Array of (start, kind number, end, value) of a kind's matches; empty where there are none."""
    number, none = KINDS.index(kind), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    kept = found if keep is None else F.filter(found, keep)
    return F.coalesce(
        F.transform(
            kept,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), F.element_at(F.split(m["part"], CUT, -1), -1).alias("value")
            ),
        ),
        none,
    )


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, owner columns, and ``base`` and ``added`` span candidates of every row, without the text.

    Null and empty texts have no spans; repeated rows have equal spans. The owner is the repository's name up to its
    first slash, the repository where it has none; a null source is one owner of its own.
    """
    text = F.translate(whole(), MARK + CUT, PLAIN + PLAIN)
    marked = F.regexp_replace(F.col("text"), ASSIGN, f"{MARK}$1{CUT}$2{MARK}")
    assign = F.when(F.regexp_like(F.col("text"), F.lit(ASSIGN)), _cells(marked))
    long_enough = lambda m: F.length(F.element_at(F.split(m["part"], CUT, -1), -1)) >= 8
    mixed = lambda m: reduce(and_, [F.regexp_like(m["part"], F.lit(c)) for c in MIXED])
    return (
        docs.select(*keep, F.col("source").alias("repository"), F.substring_index("source", "/", 1).alias("owner"), text.alias("text"))
        .withColumns(
            {
                "assign": _spans("assign", assign, long_enough),
                "access": _spans("access", _matches(F.col("text"), ACCESS)),
                "hex": _spans("hex", _matches(F.col("text"), HEX)),
                "opaque": _spans("opaque", _matches(F.col("text"), OPAQUE), mixed),
            }
        )
        .drop("text")
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners): distinct repositories and owners that hold a value.

    Two rounds of map-side combining: first one row a value and repository, then counts. A value that a third of all
    rows hold is one row a map task after the first.
    """
    pairs = candidates.select("value_hash", "repository", "owner").distinct()
    return pairs.groupBy("value_hash").agg(
        (F.count_distinct("repository") + F.max(F.col("repository").isNull().cast("int"))).alias("n_repositories"),
        (F.count_distinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("n_owners"),
    )


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, repository, counts a kind, ``base`` and ``spans`` arrays of (start, kind, end, n_owners, n_repositories) in order.

    Only rows with candidates are dealt out; the others, nearly all, stay where they are.
    """
    base_kinds = len(KINDS) - 1
    rows = stored(scan(docs, keep).withColumn("row", F.monotonically_increasing_id()), "secrets")
    every = F.concat("assign", "access", "hex", "opaque")
    candidates = (
        rows.where(F.size(every) > 0)
        .select("row", "repository", "owner", F.explode(every).alias("span"))
        .select("row", "repository", "owner", "span", F.sha2("span.value", 256).alias("value_hash"))
    )
    # Written first: a value that very many rows hold is then a large partition of a plain exchange, which Spark can split.
    owned = stored(ownership(candidates), "ownership")
    judged = (
        candidates.join(owned, "value_hash")
        .select("row", F.struct("span.start", "span.kind", "span.end", "n_owners", "n_repositories").alias("s"))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("s.kind") < base_kinds, F.col("s")))).alias("base"),
            # A span is added if its value has one owner and no base span covers a part of it.
            F.collect_list(F.when((F.col("s.kind") >= base_kinds) & (F.col("s.n_owners") == 1), F.col("s"))).alias("others"),
        )
    )
    clear = F.filter("others", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    with_spans = rows.where(F.size(every) > 0).join(judged, "row").select(*keep, "repository", *counts, "base", F.array_sort(F.concat("base", clear)).alias("spans"))
    none = F.array().cast(judged.schema["base"].dataType)
    return with_spans.unionByName(rows.where(F.size(every) == 0).select(*keep, "repository", *counts, none.alias("base"), none.alias("spans")))


def joined(spans: str) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), ["doc_id"])
    live = F.filter("spans", lambda s: s["n_owners"] < EXAMPLE_OWNERS)
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("spans") - F.size(live)).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, fill: str = "*") -> DataFrame:
    """The rows with every live-looking secret overwritten by ``fill``, character by character; examples stay.

    Values that EXAMPLE_OWNERS owners or more hold are copied examples and stay. n_chars is kept, as lengths are. Null texts
    stay null; repeated rows stay; columns may have any names; an empty table gives an empty one.
    """
    plain, back = by_place(docs, "text", "source")
    others = [c for c in plain.columns if c not in ("text", "source")]
    found = find(plain.withColumn("whole", F.col("text")), [*others, "whole"])
    live = found.withColumn("live", F.filter("spans", lambda s: s["n_owners"] < EXAMPLE_OWNERS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        end = F.greatest(begin, s["end"])
        return F.struct(
            F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(fill), end - begin)).alias("out"),
            end.alias("at"),
        )

    clean = F.aggregate("live", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, F.length("whole"))))
    text = F.when(F.size("live") > 0, clean).otherwise(F.col("whole"))
    return back(live.select(*others, text.alias("text"), F.col("repository").alias("source")))
