"""Structure repair of conversations: cheapest edits by layers that conversations with a common prefix of signatures share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored

c = F.col
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Place in the repaired order `(s?(ua)+)?`: nothing yet, after the system row, after a user's row, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Letters that may follow directly, as (from, letter, to).
FOLLOWS = [(NOTHING, "s", SYSTEM), *[(p, "u", USER) for p in (NOTHING, SYSTEM, ASSISTANT)], (USER, "a", ASSISTANT)]
#: From each place, the place after an inserted row: the only one that keeps the order.
INSERTED = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: Inserted rows that complete the order.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ORDER = ["turn", "role", "k1", "k2"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, k1, k2, gone) after the damage that each row's crc32 of `conv_id:turn` chooses; dropped rows
    stay as ``gone``. k1 and k2 are hashes of role and text."""
    words = lambda n: F.coalesce(c(n).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", words("conv_id"), words("turn")).cast("binary")) % 20
    rows = conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), words("role").alias("role"), words("text").alias("text"), fate.alias("fate"))
    text = F.when(c("fate") == 1, "").when(c("fate") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    rows = rows.withColumn("text", F.when(c("fate") != 0, text).otherwise(F.lit(""))).withColumn("role", F.when(c("fate") == 4, "user").otherwise(c("role")))
    rows = rows.withColumn("copy", F.explode(F.when(c("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", "role", "text", F.xxhash64("role", "text", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "text", "role").alias("k2"), (c("fate") == 0).alias("gone")
    )


def _symbol() -> Column:
    """What the edits depend on: `x` for rows that must go, else the role's initial, `o` for any other; upper case if truncated."""
    initial = F.when(c("initial").isin("s", "u", "a"), c("initial")).otherwise("o")
    return F.when(c("fault").isin("blank", "duplicate"), "x").when(c("fault") == "truncated", F.upper(initial)).otherwise(initial)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation. What is sorted here are light
    rows without texts, which stream through; no conversation is held."""
    bare = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv_id", *ORDER, "gone", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("empty"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("whole"))
    seen = Window.partitionBy("conv_id", "gone", "k1", "k2").orderBy("turn", "role")
    light = light.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(c("empty"), "blank").when(c("again"), "duplicate").when(~c("whole"), "truncated").otherwise("")
    light = light.withColumn("fault", fault).withColumn("symbol", _symbol()).sortWithinPartitions("conv_id", *ORDER)
    light = light.select("conv_id", "turn", "gone", "initial", "fault", "symbol")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for b in batches:
            done = []
            for conv_id, *row in zip(*[b.column(n).to_pylist() for n in light_names], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(*row)
            if done:
                yield _told(done, names)
        if now is not None:
            yield _told([now.row()], names)

    light_names = light.columns
    return light.mapInArrow(told, ", ".join(f"{n} {'string' if n == 'signature' else 'long'}" for n in names))


def _told(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "signature" else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)


class _Conversation:
    """Counts and signature of one conversation, row by row in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.symbols, self.faults, self.illegal = conv_id, [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0
        self.first = self.last = self.before = None
        self.distinct = 0

    def add(self, turn: int | None, gone: bool, initial: str, fault: str, symbol: str) -> None:
        if gone:
            return
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.distinct += 1
        if self.before is not None and (self.before, initial) not in (("s", "u"), ("u", "a"), ("a", "u")):
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        self.symbols.append(symbol)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        wrapped = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        return (self.conv_id, wrapped, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, "".join(self.symbols))


def moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of one row. Rows are inserted right before a row that stays: before a deleted one they would cost
    the same and read greater, and two in a row would be in vain."""
    out = [(p, p, DELETE, "D") for p in CLOSING]
    if symbol == "x":
        return out
    extra = TRUNCATED if symbol.isupper() else 0
    kinds = [(symbol.lower(), "K", extra)] + [(to, "R", REROLE + extra) for to in "ua"]
    for letter, edit, cost in kinds:
        for p, follows, to in FOLLOWS:
            if follows == letter:
                out.append((p, to, cost, edit))
                out += [(q, to, INSERT + cost, "I" + edit) for q, into in INSERTED.items() if into == p]
    return out


#: A layer: for each place that can be reached, (cost, rank, place before, edits). The rank orders the audits so far of one layer.
Layer = dict[int, tuple[int, int, int, str]]


def step(layer: Layer, symbol: str, _known: dict[str, list] = {}) -> Layer:  # noqa: B006
    """The layer after one more row. All audits of a layer end with the same row's edit, so that none is a proper prefix of another:
    where two differ, the order of what follows doesn't matter, and ranks do for whole strings."""
    if symbol not in _known:
        _known[symbol] = moves(symbol)
    best: dict[int, tuple[int, int, str, int]] = {}
    for p, to, cost, edits in _known[symbol]:
        if p in layer:
            way = (layer[p][0] + cost, layer[p][1], edits, p)
            if to not in best or way < best[to]:
                best[to] = way
    order = sorted(best, key=lambda to: best[to][1:3])
    return {to: (best[to][0], order.index(to), best[to][3], best[to][2]) for to in best}


def audit(layers: list[Layer]) -> tuple[int, str]:
    """Cost and audit of the whole signature: the cheapest end, of equal ones the least audit."""
    cost, _, edits, place = min((x[0] + INSERT * len(CLOSING[p]), x[1], CLOSING[p], p) for p, x in layers[-1].items())
    parts = [edits]
    for layer in reversed(layers[1:]):
        _, _, place, edits = layer[place]
        parts.append(edits)
    return cost, "".join(reversed(parts))


def answers(told: DataFrame) -> DataFrame:
    """(signature, cost, audit) of all distinct signatures: each range of them in order, as a walk through their trie whose layers
    stay as far as the next signature has the prefix in common."""
    distinct = told.select("signature").distinct()
    ranged = distinct.repartitionByRange(partitions(told.sparkSession), "signature").sortWithinPartitions("signature")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, layers = "", [{NOTHING: (0, 0, NOTHING, "")}]
        for b in batches:
            found = []
            for s in b.column("signature").to_pylist():
                shared = 0
                while shared < min(len(path), len(s)) and path[shared] == s[shared]:
                    shared += 1
                del layers[shared + 1 :]
                for symbol in s[shared:]:
                    layers.append(step(layers[-1], symbol))
                path = s
                found.append(audit(layers))
            if found:
                costs, audits = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])

    return ranged.mapInArrow(walk, "signature string, cost long, audit string")


def repair(conversations: DataFrame) -> DataFrame:
    """Each conversation's faults after the damage, cheapest edits, and the digest of what they make of it (the contract of op11).

    Null roles and texts are one space, and so is a null conv_id or turn where the crc32 reads it. Rows of one turn come in the
    order of their roles, then of a hash of role and text; rows that agree in all count one by one. Rows without a conv_id are one
    conversation, whose conv_id is null. ``gaps`` is modulo 2^64. An empty table gives no rows.

    Edits depend on a row's initial and fault only. Distinct signatures are sorted, their trie's layers computed once a shared
    prefix, and answers joined back. A digest takes in a conversation's rows in order: they are sorted by Spark, on disk where
    need be, after one row with the conversation's audit, and stream through.
    """
    rows = damaged(conversations)
    told = stored(signatures(rows), "signatures")
    known = told.join(stored(answers(told), "answers"), "signature").drop("signature")
    shown = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = known.select("conv_id", F.lit(True).alias("head"), *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("k1", "long"), ("k2", "long"), ("text", "string"))], *shown)
    body = rows.where("not gone").select("conv_id", F.lit(False).alias("head"), *ORDER, "text", *[F.lit(None).cast("string" if n == "audit" else "long").alias(n) for n in shown])
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", c("head").desc(), *ORDER).select("conv_id", "head", "role", "text", *shown)
    kinds = {"conv_id": pa.int64()} | {n: pa.string() if n == "audit" else pa.int64() for n in shown} | {"repaired_sha256": pa.string()}

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        repaired = None
        for b in batches:
            done = []
            for conv_id, head, role, text, *told in zip(*[b.column(n).to_pylist() for n in both_names], strict=True):
                if head:
                    if now is not None:
                        done.append((*now, repaired.digest()))
                    now, repaired = (conv_id, *told), _Repaired(told[-1])
                else:
                    repaired.add(role, text)
            if done:
                yield table(done)
        if now is not None:
            yield table([(*now, repaired.digest())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds.values(), strict=True)], names=list(kinds))

    both_names = both.columns
    return both.mapInArrow(digested, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds.items()))


class _Repaired:
    """Digest of the repaired rows, as the audit's edits meet the rows in order."""

    def __init__(self, edits: str) -> None:
        self.edits, self.at, self.place, self.sha, self.first = edits, 0, NOTHING, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.place, self.at = INSERTED[self.place], self.at + 1
            self._put("user" if self.place == USER else "assistant", "")

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "D":
            return
        if edit == "K":
            self.place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self._put(role, text)
        else:
            self.place = INSERTED[self.place]
            self._put("user" if self.place == USER else "assistant", text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
