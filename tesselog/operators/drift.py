"""Records whose fields drift from file to file: one consistent table and a report of the changes.

Every file's fields are read in parallel; what is shuffled are narrow rows
(producer, file, path, kind, a hash of the value), pre-aggregated per task, so a
producer or file that holds a third of the rows arrives as a few rows.  Kinds
and value shapes are folded through a small promotion lattice; the union schema
is the fold over all files; differences are logged file by file in order.

Whether a path that is gone and one that has come hold the same quantity is
told by values.  Records reported again (those of one ``link``, the request)
stand in both files: where such records hold equal values under both paths,
whatever their spelling, the field was renamed; where they hold different ones,
it wasn't.  How much an agreement tells follows from how many values a path has
at all.  Only where no such record holds both paths, overlap and size of all
values of the two files decide together with the names; names break ties else.

Defined cases: payloads that are null, cut off or no JSON object are not
readable and carry no fields; a file without a readable payload is passed over
(the next one is compared with the one before it); rows without a producer or
file_seq stay out of the report but not out of the table; rows of one record_id
count once, the one received last; rows with a null record_id are left out of
the table; a path whose values have several kinds in one file counts as the
join of them; empty names and dots inside keys are taken as they are; of
several records of one file and link one is compared.  Past MAX_COLUMNS columns, by name, fields stay texts in
``other_fields``; a second leaf of one path, which a dot inside a key can make,
goes by the path with a number.
"""

from __future__ import annotations

import datetime
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselog.session import materialise, ship

#: Words of a path that say where or in what unit a quantity is kept, not which one it is.
PLACE_WORDS = frozenset("id name usd ms count is at token service message usage timing status trace label".split())
#: Words for one quantity.
SAME_WORDS = {"in": "input", "prompt": "input", "out": "output", "completion": "output", "ts": "time", "timestamp": "time", "created": "time", "date": "time", "billing": "cost", "price": "cost", "duration": "latency", "elapsed": "latency"}

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _single(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is", "ts")) and len(word) > 3 else word


@lru_cache(maxsize=1 << 16)
def quantity(path: str) -> str:
    """The quantity that a dotted path holds, whatever its spelling, nesting or unit suffix.

    >>> quantity("message.usage.input_tokens") == quantity("tokensIn") == quantity("tokens_in")
    True
    >>> quantity("time.at") == quantity("createdAt") == quantity("ts")
    True
    """
    words = [_single(w.lower()) if w.lower() != "ts" else "ts" for w in _WORD.findall(path)]
    told = {SAME_WORDS.get(w, w) for w in words if w not in PLACE_WORDS}
    return "_".join(sorted(told or set(words))) or path


# -- the promotion lattice -------------------------------------------------------------------
#: kinds of JSON values; of several in one file the join is the kind
KINDS = ("number", "string", "boolean", "array")

#: Value shapes and the SQL type each has alone.
_SQL = {"bit": "bigint", "int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp", "array": "array<string>", "text": "string"}


def join_kinds(kinds) -> str:
    """The join of kinds: equal kinds stay, different ones meet at string."""
    kinds = set(kinds)
    return kinds.pop() if len(kinds) == 1 else "string"


def join_shapes(a: str, b: str) -> str:
    """Least upper bound of two value shapes.

    bit (0 or 1) is below int and bool, int below float and time (milliseconds),
    text below array (a comma list); any other two meet at text.

    >>> join_shapes("bit", "bool"), join_shapes("int", "float"), join_shapes("int", "time"), join_shapes("bool", "float")
    ('bool', 'float', 'time', 'text')
    """
    if a == b:
        return a
    pair = {a, b}
    if "array" in pair:
        return "array"
    for low, high in (("bit", "int"), ("bit", "bool"), ("bit", "float"), ("bit", "time"), ("int", "float"), ("int", "time")):
        if pair == {low, high}:
            return high
    return "text"


_INT = re.compile(r"[+-]?\d{1,18}")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?( ?(Z|[+-]\d\d:?\d\d))?")


def shape(value) -> str:
    """The shape of one JSON leaf; strings that spell a number, truth value or time have its shape."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, list):
        return "array"
    if isinstance(value, int):
        return "bit" if value in (0, 1) else "int" if -(2**63) <= value < 2**63 else "float"
    if isinstance(value, float):
        return "float"
    text = value.strip()
    if text.lower() in ("true", "false"):
        return "bool"
    if _INT.fullmatch(text):
        return "bit" if text in ("0", "1") else "int"
    return "float" if _FLOAT.fullmatch(text) else "time" if _TIME.fullmatch(text) else "text"


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array"


def leaves(node, prefix: str = ""):
    """(dotted path, value) of each leaf that is not null; arrays are leaves, empty objects have none."""
    stack = [(prefix, node)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
        elif value is not None:
            yield path, value


def _payload(text: str | None) -> dict | None:
    try:
        got = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


# -- fields of the files -----------------------------------------------------------------------
def _plain_text(text: str, kind: str) -> str:
    """``plain`` of a stripped text of a known shape."""
    if kind == "text":
        return ",".join(x.strip() for x in text.split(",")) if "," in text else text
    if kind in ("bit", "int"):
        return str(int(text))
    if kind == "bool":
        return "1" if text.lower() == "true" else "0"
    if kind == "float":
        return plain(float(text)) if math.isfinite(float(text)) else text
    try:
        at = datetime.datetime.fromisoformat(text.replace(" Z", "Z"))
    except ValueError:
        return text
    return str(round((at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp() * 1000))


def plain(value) -> str:
    """A leaf without its spelling: numbers, truth values and times in digits or text, lists and their comma forms are told by what they say."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return _plain_text(value.strip(), shape(value))
    if isinstance(value, float):
        return repr(value) if not math.isfinite(value) or abs(value) < 2**53 and value != int(value) else str(int(value))
    return ",".join(plain(x) if not isinstance(x, (dict, list)) and x is not None else json.dumps(x) for x in value)


def _hash(said: str) -> int:
    return zlib.crc32(said.encode("utf-8", "surrogatepass")) - 2**31


@lru_cache(maxsize=1 << 14)
def _text_leaf(text: str) -> tuple[int, int, float]:
    kind, bare = shape(text), text.strip()
    size = len(text)
    if kind in ("bit", "int", "float"):
        size = abs(float(bare)) if math.isfinite(float(bare)) else size
    return 2 | (_TEXT if kind == "text" else 0), _hash(_plain_text(bare, kind)), math.log10(1 + size)


#: Kinds as bits, so that many fold by a bitwise or: number, string, boolean, array; and whether a value is a text of no other shape.
_KIND_BITS = {"number": 1, "string": 2, "boolean": 4, "array": 8}
_TEXT = 16


def _leaf(value) -> tuple[int, int, float]:
    """(bits of its kind, hash of what it says, order of its size) of a JSON leaf."""
    kind = type(value)
    if kind is str:
        return _text_leaf(value)
    said = plain(value)
    if kind is int:
        return 1, _hash(said), math.log10(1 + abs(value))
    size = abs(value) if kind is not list and math.isfinite(value) else len(said)
    return _KIND_BITS[_kind(value)], _hash(said), math.log10(1 + size)


_LEAF = "struct<path:string,kind:int,value:int,size:float>"
_RECORDS = f"producer string, file_seq bigint, link string, leaves array<{_LEAF}>"
_LEAF_ARROW = pa.struct([("path", pa.string()), ("kind", pa.int32()), ("value", pa.int32()), ("size", pa.float32())])


def _records(link: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            producers, seqs, links, ends = [], [], [], [0]
            paths: list[str] = []
            said: list[tuple] = []
            for producer, seq, text in zip(*(batch.column(k).to_pylist() for k in ("producer", "file_seq", "payload"))):
                got = _payload(text)
                if got is None:
                    continue
                name = None
                for path, value in leaves(got):
                    if path == link:
                        name = plain(value)
                    paths.append(path)
                    said.append(_leaf(value))
                producers.append(producer)
                seqs.append(seq)
                links.append(name)
                ends.append(len(paths))
            columns = [paths, *(list(zip(*said)) or [()] * 3)]
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEAF_ARROW)], fields=list(_LEAF_ARROW))
            yield pa.RecordBatch.from_arrays(
                [pa.array(producers, pa.string()), pa.array(seqs, pa.int64()), pa.array(links, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
                names=["producer", "file_seq", "link", "leaves"],
            )

    return run


LINK = "request_id"


def records(usage: DataFrame, link: str = LINK) -> DataFrame:
    """producer, file_seq, link, leaves: a row for each readable payload; leaves have path, kind, shape, a hash of the value and its size."""
    ship(usage.sparkSession)
    return usage.select("producer", F.col("file_seq").cast("bigint").alias("file_seq"), "payload").mapInArrow(_records(link), _RECORDS)


#: A path's values in a file are sketched by the smallest hash of each of so many classes.
SKETCH = 16


def file_schemas(read: DataFrame) -> DataFrame:
    """producer, file_seq, fields array<struct<path, kind, text, sketch, size, bits>>: a row for each readable file; bits is the information of one value of the path."""
    each = read.select("producer", "file_seq", F.explode_outer("leaves").alias("l")).select("producer", "file_seq", "l.*")
    least = [F.min(F.when(F.pmod("value", F.lit(SKETCH)) == i, F.col("value"))).alias(f"v{i}") for i in range(SKETCH)]
    per = each.groupBy("producer", "file_seq", "path").agg(F.bit_or("kind").alias("kinds"), F.avg("size").alias("size"), *least)
    only = F.col("kinds").bitwiseAND(F.lit(_TEXT - 1))
    kind = F.lit("string")
    for name, bit in _KIND_BITS.items():
        kind = F.when(only == bit, name).otherwise(kind)
    sketch = F.filter(F.array(*(f"v{i}" for i in range(SKETCH))), lambda x: x.isNotNull())
    per_path = materialise(per.select("producer", "file_seq", "path", kind.alias("kind"), (F.col("kinds") >= _TEXT).alias("text"), sketch.alias("sketch"), "size"), "fields")
    # how many values a path has: those seen in the sketches, or what a file's occupied classes tell
    k = F.size("sketch")
    counted = -SKETCH * F.log(1 - F.least(k, F.lit(SKETCH - 0.5)) / SKETCH)
    known = per_path.select("path", counted.alias("c"), F.explode("sketch").alias("v")).groupBy("path").agg(F.log2(F.greatest(F.approx_count_distinct("v") + 0.0, F.max("c"))).alias("bits"))
    fields = F.struct("path", "kind", "text", "sketch", "size", "bits")
    return per_path.join(known, "path", "left").groupBy("producer", "file_seq").agg(F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), fields))).alias("fields"))


# -- what was renamed ------------------------------------------------------------------------
def _words(path: str) -> list[str]:
    return [_single(w.lower()) for w in _WORD.findall(path)]


def names_alike(a: str, b: str) -> float:
    """From 0 to 1: the share of words of two paths that are equal or begin one another.

    >>> names_alike("input_tokens", "tokensIn"), names_alike("user_id", "user_name"), names_alike("ts", "createdAt")
    (1.0, 0.5, 0.0)
    """
    one, two = _words(a), _words(b)
    total, met = len(one) + len(two), 0
    for w in one:
        hit = next((x for x in two if x == w), None) or next((x for x in two if min(len(x), len(w)) > 1 and (x.startswith(w) or w.startswith(x))), None)
        if hit is not None:
            met += 1
            two.remove(hit)
    return 2 * met / total if total else 0.0


#: Bits of agreement that make a rename sure whatever the names (a chance of 1 in 1 000).
SURE = 10.0


def match_fields(gone: list[dict], come: list[dict], votes: dict[tuple[str, str], tuple[int, int]], same_name: Callable[[str, str], bool]) -> list[tuple[dict, dict]]:
    """The pairs of fields of one file pair that were renamed, each field once; votes are (records with both, those that agree)."""
    found = []
    for a in gone:
        for b in come:
            both, agree = votes.get((a["path"], b["path"]), (0, 0))
            alike = names_alike(a["path"], b["path"])
            bits = min(a["bits"] or 0.0, b["bits"] or 0.0)
            named = alike > 0.6 or same_name(a["path"], b["path"])
            if both:
                # more than half agree, and the agreement is no accident or the names speak for it
                ok, told = 2 * agree > both and (agree * bits >= SURE or alike >= 0.5 or named), agree * max(bits, 0.5)
            else:
                overlap = len(set(a["sketch"]) & set(b["sketch"]))
                near = abs((a["size"] or 0.0) - (b["size"] or 0.0)) < 0.7
                texts = a["text"] or b["text"]
                ok = overlap > 0 and (named or overlap * bits >= 2 * SURE) or not overlap and near and (alike > 0.6 if texts else named) and a["text"] == b["text"]
                told = overlap * max(bits, 0.5) * 0.1
            if ok:
                found.append((-told - 4 * alike, a["path"], b["path"], a, b))
    out, left, right = [], set(), set()
    for _, x, y, a, b in sorted(found, key=lambda f: f[:3]):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            out.append((a, b))
    return out


def _report(synonyms: bool):
    def same(a: str, b: str) -> bool:
        return synonyms and quantity(a) == quantity(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key, gone, come = (r["producer"], r["file_seq"]), r["gone"] or [], r["come"] or []
                pairs = match_fields(gone, come, {(v["a"], v["b"]): (v["both"], v["agree"]) for v in r["votes"] or []}, same)
                done = {a["path"] for a, _ in pairs}, {b["path"] for _, b in pairs}
                rows += [(*key, "removed", a["path"], "") for a in gone if a["path"] not in done[0]]
                rows += [(*key, "added", "", b["path"]) for b in come if b["path"] not in done[1]]
                for a, b in pairs:
                    rows.append((*key, "renamed", a["path"], b["path"]))
                    if a["kind"] != b["kind"]:
                        rows.append((*key, "retyped", a["path"], b["path"]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["producer", "file_seq", "change", "old_field", "new_field"])

    return run


def changes(usage: DataFrame, link: str = LINK, synonyms: bool = True) -> DataFrame:
    """producer, file_seq, change, old_field, new_field: the differences of each file from the one before it.

    ``link`` is the path whose value names a record that may be reported again.
    ``synonyms`` lets the word list of ``quantity`` speak for a rename where
    names alone differ; it never outweighs values that differ.
    """
    read = materialise(records(usage.where("producer is not null and file_seq is not null"), link), "records")
    schemas = materialise(file_schemas(read), "schemas")
    # the order of files is found on narrow rows; the schemas follow by equi joins on the file
    order = Window.partitionBy("producer").orderBy("file_seq")
    steps = schemas.select("producer", "file_seq", F.lag("file_seq").over(order).alias("before")).where("before is not null")
    now = schemas.withColumnRenamed("fields", "new")
    old = schemas.select("producer", F.col("file_seq").alias("before"), F.col("fields").alias("old"))
    names = lambda c: F.transform(c, lambda x: x["path"])
    both = steps.join(now, ["producer", "file_seq"]).join(old, ["producer", "before"])
    both = both.withColumn("kept", F.array_intersect(names(F.col("old")), names(F.col("new"))))
    both = materialise(
        both.select(
            "producer",
            "file_seq",
            "before",
            F.filter("old", lambda x: ~F.array_contains("kept", x["path"])).alias("gone"),
            F.filter("new", lambda x: ~F.array_contains("kept", x["path"])).alias("come"),
            F.filter("old", lambda x: F.array_contains("kept", x["path"])).alias("was"),
            F.filter("new", lambda x: F.array_contains("kept", x["path"])).alias("now"),
        ),
        "steps",
    )
    open_ = both.where((F.size("gone") > 0) & (F.size("come") > 0))

    # records of one link in one file and the one before, each with (hash of path, hash of value) of its leaves: one shuffle of narrow rows
    told = F.transform("leaves", lambda x: F.struct(F.hash(x["path"]).alias("p"), x["value"].alias("v")))
    again = Window.partitionBy("producer", "link").orderBy("file_seq", "told")
    rows = read.where("link is not null").select("producer", "link", "file_seq", told.alias("told"))
    met = rows.withColumns({"before": F.lag("file_seq").over(again), "old": F.lag("told").over(again)}).where("before < file_seq").drop("link")
    marked = lambda c: F.transform(c, lambda x: F.struct(x["path"].alias("path"), F.hash(x["path"]).alias("p")))
    want = open_.select("producer", "file_seq", "before", marked("gone").alias("gone"), marked("come").alias("come"))
    under = lambda fields, leaf: F.filter(F.transform(fields, lambda f: F.struct(f["path"].alias("path"), F.get(F.filter(leaf, lambda x: x["p"] == f["p"]), 0)["v"].alias("v"))), lambda x: x["v"].isNotNull())
    met = met.join(want, ["producer", "file_seq", "before"]).select("producer", "file_seq", under(F.col("gone"), F.col("old")).alias("gone"), under(F.col("come"), F.col("told")).alias("come"))
    pairs = F.flatten(F.transform("gone", lambda a: F.transform("come", lambda b: F.struct(a["path"].alias("a"), b["path"].alias("b"), (a["v"] == b["v"]).alias("same")))))
    votes = met.select("producer", "file_seq", F.explode(pairs).alias("p")).groupBy("producer", "file_seq", "p.a", "p.b").agg(F.count("*").alias("both"), F.count_if("p.same").alias("agree"))
    votes = votes.groupBy("producer", "file_seq").agg(F.collect_list(F.struct("a", "b", "both", "agree")).alias("votes"))
    schema = "producer string, file_seq bigint, change string, old_field string, new_field string"
    differ = both.where((F.size("gone") > 0) | (F.size("come") > 0)).select("producer", "file_seq", "gone", "come").join(votes, ["producer", "file_seq"], "left")
    moved = differ.mapInArrow(_report(synonyms), schema)
    # both lists of kept fields are in order of their paths
    stayed = both.select("producer", "file_seq", F.explode(F.arrays_zip(F.col("was").alias("a"), F.col("now").alias("b"))).alias("p")).where("p.a.kind <> p.b.kind")
    return moved.unionByName(stayed.select("producer", "file_seq", F.lit("retyped").alias("change"), F.col("p.a.path").alias("old_field"), F.col("p.b.path").alias("new_field")))


# -- one consistent table -----------------------------------------------------------------------
#: More columns than this stay together in one map column instead of columns of their own.
MAX_COLUMNS = 1000

_SAID = "struct<path:string,text:string,shape:string>"
_SAID_ARROW = pa.struct([("path", pa.string()), ("text", pa.string()), ("shape", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        readable, apart, ends = [], [], [0]
        paths, texts, shapes = [], [], []
        for text in batch.column("payload").to_pylist():
            got = _payload(text)
            seen: dict[str, str] = {}
            mixed: set[str] = set()
            met: set[str] = set()
            for path, value in leaves(got or {}):
                said = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
                name = quantity(path)
                if name in seen and seen[name] != plain(value):  # two values of one quantity in one record: it is no one quantity
                    mixed.add(name)
                seen.setdefault(name, _Lazy(value))
                if path in met:  # a key with a dot and a nested key can have one path
                    path = f"{path}#{len(met)}"
                met.add(path)
                paths.append(path)
                texts.append(said)
                shapes.append(shape(value))
            readable.append(got is not None)
            apart.append(sorted(mixed))
            ends.append(len(paths))
        inner = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (paths, texts, shapes)], fields=list(_SAID_ARROW))
        keep = [batch.column(k) for k in ("record_id", "producer", "file_seq", "line_no")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(readable), pa.array(apart, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
            names=["record_id", "producer", "file_seq", "line_no", "readable", "apart", "leaves"],
        )


class _Lazy:
    """A leaf that is compared by what it says, which is found out only then."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __eq__(self, said):
        return plain(self.value) == said

    __hash__ = None


def texts(records_: DataFrame) -> DataFrame:
    """record_id, producer, file_seq, line_no, readable, apart, leaves (path, text, shape): one parse of each record; apart names the quantities that it has different values of."""
    ship(records_.sparkSession)
    schema = f"record_id bigint, producer string, file_seq int, line_no int, readable boolean, apart array<string>, leaves array<{_SAID}>"
    return records_.select("record_id", "producer", F.col("file_seq").cast("int").alias("file_seq"), F.col("line_no").cast("int").alias("line_no"), "payload").mapInArrow(_texts, schema)


def union_schema(rows: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """(path -> column, column -> SQL type) of rows of ``texts``: the fold of all shapes, of at most MAX_COLUMNS columns by name with ten times as many paths.

    Paths of one quantity share a column unless some record holds different
    values under two of them; then each path has its own.
    """
    per = rows.select(F.explode("leaves").alias("l")).groupBy("l.path").agg(F.sort_array(F.collect_set("l.shape")).alias("shapes"))
    found = per.orderBy("path").limit(MAX_COLUMNS * 10).collect()
    apart = {r[0] for r in rows.select(F.explode("apart")).distinct().limit(MAX_COLUMNS * 10).collect()}
    of, kinds = {}, {}
    for path, shapes in found:
        name = quantity(path)
        name = re.sub(r"\W+", "_", path) if name in apart else name
        of[path] = name
        for s in shapes:
            kinds[name] = join_shapes(kinds.get(name, s), s)
    first = sorted(kinds)[:MAX_COLUMNS]
    return {p: c for p, c in of.items() if c in set(first)}, {c: _SQL[kinds[c]] for c in first}


def _cast(value, kind: str):
    text = F.trim(value)
    if kind == "timestamp":
        return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), text.try_cast("timestamp")))
    if kind == "boolean":
        return F.when(value.isNotNull(), F.lower(text).isin("true", "1"))
    if kind == "array<string>":
        return F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), F.split(text, r"\s*,\s*"))
    return value if kind == "string" else text.try_cast(kind)


def latest_records(usage: DataFrame) -> DataFrame:
    """One row for each record_id, the one received last."""
    best = F.max(F.struct("received_at", "payload", "producer", "file_seq", "line_no")).alias("b")
    return usage.where("record_id is not null").groupBy("record_id").agg(best).select("record_id", "b.producer", "b.file_seq", "b.line_no", "b.payload")


def consistent(usage: DataFrame, link: str = LINK) -> DataFrame:
    """All readable records under the union schema; requests reported again count once.

    Of several records of one ``link`` and producer the one of the earliest
    file counts.  A value whose path has no column (beyond MAX_COLUMNS) stays in
    other_fields by path; of values of one column in one record, which all say
    the same, the first by path stands.
    """
    rows = materialise(texts(latest_records(usage)).where("readable"), "texts")
    of, schema = union_schema(rows)
    pair = F.transform("leaves", lambda x: F.struct(x["path"], x["text"])).alias("e")
    key = F.coalesce(F.get(F.filter("leaves", lambda x: x["path"] == link), 0)["text"], F.concat(F.lit("\0"), F.col("record_id").cast("string")))
    first = F.min(F.struct(F.coalesce("file_seq", F.lit(2**31 - 1)).alias("s"), "record_id", "file_seq", "line_no", pair)).alias("b")
    once = rows.groupBy("producer", key.alias("_key")).agg(first)
    once = once.select("b.record_id", "producer", "b.file_seq", "b.line_no", F.map_from_entries("b.e").alias("fields"))
    taken = {"record_id", "producer", "file_seq", "line_no", "other_fields"}
    under: dict[str, list[str]] = {}
    for path, name in of.items():
        under.setdefault(name, []).append(path)
    value = lambda q: F.coalesce(*(F.element_at("fields", F.lit(p)) for p in under[q]))
    columns = [_cast(value(q), t).alias(q if q not in taken else f"{q}_value") for q, t in schema.items()]
    rest = F.map_filter("fields", lambda k, _: ~k.isin(list(of)) if of else F.lit(True)).alias("other_fields")
    return once.select("record_id", "producer", "file_seq", "line_no", *columns, rest)
