"""Problem 6: layer descriptions whose schema drifts from file to file, as one table and a report of changes.

Rescue-column ingestion: each description is held to the target schema (type, base, data, target); fields it doesn't
know and values it can't cast are kept as JSON in ``rescued``. Approved spellings are then promoted: their rescued
values are replayed into the typed columns. Changes are found between each file and the one before it in its series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlake.operators.shred import parsed
from tierlake.plans.shared import cut

# Approved spellings of the attributes' keys, lower case and without marks between words.
APPROVED = {
    "type": ["type", "layertype", "kind"],
    "base": ["base", "baselayer", "parent", "on"],
    "data": ["data", "datatype", "datakind"],
    "target": ["target", "targetlayer"],
}
ATTRS = list(APPROVED)
#: Files of a series that are lined up in one group; a longer series is a chain of such groups.
GROUP = 4096

LAYERS = "file_id bigint, ord int, layer string, type string, base string, data string, target string, rescued map<string,string>"
_STRINGS = pa.map_(pa.string(), pa.string())


def cast(attr: str, value: object) -> tuple[bool, str | None]:
    """(whether the target schema takes the value, the value as held): words as they are, lists of words as JSON; null, empty and absent as null."""
    if value is None or value == "" or value == []:
        return True, None
    if isinstance(value, str):
        return True, value
    if attr == "data" and isinstance(value, list) and all(isinstance(x, str) for x in value):
        return True, json.dumps(value, ensure_ascii=False)
    return False, None


def described(header: str | None) -> list[tuple[str, dict]]:
    """(name, description) of each layer of a header in its order; ``_meta`` is an object by name or an array with names."""
    meta = parsed(header)
    meta = meta.get("_meta") if isinstance(meta, dict) else None
    if isinstance(meta, dict):
        return [(k, v) for k, v in meta.items() if isinstance(v, dict)]
    if isinstance(meta, list):
        return [(x["name"], {k: v for k, v in x.items() if k != "name"}) for x in meta if isinstance(x, dict) and isinstance(x.get("name"), str)]
    return []


def ingest(files: DataFrame, content: str = "header") -> DataFrame:
    """The table LAYERS of files (file_id, header): one row for each description, held to the target schema.

    Only the attributes' own names are typed here; all other fields and uncastable values are in ``rescued``. Null and
    invalid headers and headers without layers have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, header in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    layers = described(header)
                except ValueError:
                    continue
                for i, (name, desc) in enumerate(layers):
                    typed, rescued = dict.fromkeys(ATTRS), []
                    for k, v in desc.items():
                        ok, held = cast(k, v) if k in typed else (False, None)
                        if ok:
                            typed[k] = held
                        if k not in typed or not ok or held is None:
                            rescued.append((k, json.dumps(v, ensure_ascii=False)))
                    rows.append((file, i, name, *typed.values(), rescued))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5, _STRINGS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in LAYERS.split(", ")])

    return files.select(F.col("file_id").cast("bigint"), F.col(content).cast("string")).mapInArrow(run, LAYERS)


def _plain(key: str) -> str:
    return f"lower(regexp_replace({key}, '[^A-Za-z0-9]', ''))"


def promote(layers: DataFrame, approved: dict[str, list[str]] = APPROVED) -> DataFrame:
    """``layers`` with rescued values of approved spellings replayed into the typed columns, and ``spelt``: the key each attribute came under.

    The first spelling with a value wins; what is replayed leaves ``rescued``, what can't be cast stays.
    """
    out, spelt = layers, []
    for attr, names in approved.items():
        named = lambda k: f"{_plain(k)} in ({', '.join(repr(n) for n in names)})"  # noqa: B023, E731
        lists = lambda v: f" or startswith({v}, '[\"') or {v} = '[]'" if attr == "data" else ""  # noqa: B023, E731
        castable = lambda v: f"(startswith({v}, '\"') or {v} = 'null'{lists(v)})"  # noqa: B023, E731
        # a rescued text is unquoted by reading it as the only item of an array
        text = "if(startswith(e.value, '\"'), from_json(concat('[', e.value, ']'), 'array<string>')[0], if(e.value = 'null', null, nullif(e.value, '[]')))"
        own = F.expr(f"filter(map_entries(rescued), e -> {named('e.key')})")
        values = F.expr(f"filter(transform(filter(_own, e -> {castable('e.value')}), e -> {text}), v -> v is not null and v <> '')")
        out = out.withColumn("_own", own).withColumn(f"_spelt_{attr}", F.expr(f"if({attr} is not null, '{attr}', get(_own, 0).key)"))
        out = out.withColumn(attr, F.coalesce(attr, F.get(values, F.lit(0)))).withColumn("rescued", F.expr(f"map_filter(rescued, (k, v) -> not ({named('k')} and {castable('v')}))"))
        spelt.append(F.col(f"_spelt_{attr}").alias(attr))
    return out.withColumn("spelt", F.struct(*spelt)).drop("_own", *[f"_spelt_{a}" for a in approved])


def consistent(files: DataFrame) -> DataFrame:
    """(file_id, ord, layer, type, base, data, target, rescued): all files' descriptions under one schema; type and one-word data in lower case."""
    word = "if(data is null or startswith(data, '['), data, lower(data))"
    return promote(ingest(files)).withColumn("type", F.lower("type")).withColumn("data", F.expr(word))


def counted(files: DataFrame) -> DataFrame:
    """(file_id, series_id, seq_no) of the files that count: of those of equal series and number the smallest id; none without either."""
    return files.where("series_id is not null and seq_no is not null").groupBy("series_id", "seq_no").agg(F.min("file_id").alias("file_id")).select("file_id", "series_id", "seq_no")


def preceding(files: DataFrame, group: int = GROUP) -> DataFrame:
    """(file_id, before): each counted file that has a preceding one in its series, and that one.

    A series is lined up in groups of ``group`` numbers; the first of a group takes the last of the nearest group before,
    so no task sorts a whole series, however long.
    """
    of = counted(files).withColumn("part", F.floor(F.col("seq_no") / group))
    inside = Window.partitionBy("series_id", "part").orderBy("seq_no")
    lined = of.withColumn("before", F.lag("file_id").over(inside))
    ends = of.groupBy("series_id", "part").agg(F.max_by("file_id", "seq_no").alias("last"))
    chain = ends.withColumn("previous", F.lag("last").over(Window.partitionBy("series_id").orderBy("part"))).select("series_id", "part", "previous")
    return lined.join(chain, ["series_id", "part"]).select("file_id", F.coalesce("before", "previous").alias("before")).where("before is not null")


def compare(old: list[dict], new: list[dict]) -> list[tuple[str, str, str]]:
    """(layer, attr, change_kind) from the descriptions of one file to those of the next."""
    was, now = {x["layer"]: x for x in old}, {x["layer"]: x for x in new}
    names_old, names_new = list(was), list(now)
    renamed = {a: b for a, b in zip(names_old, names_new) if a not in now and b not in was}
    while True:
        same = {
            a: b
            for a, b in renamed.items()
            if all(was[a][k] == now[b][k] for k in ("type", "data")) and all(renamed.get(was[a][k], was[a][k]) == now[b][k] for k in ("base", "target"))
        }
        if len(same) == len(renamed):
            break
        renamed = same
    out = [(b, "layer", "renamed") for b in renamed.values()]
    out += [(x, "layer", "removed") for x in names_old if x not in now and x not in renamed]
    out += [(x, "layer", "added") for x in names_new if x not in was and x not in renamed.values()]
    for name in names_new:
        if name not in was:
            continue
        for attr in ATTRS:
            a, b = was[name][attr], now[name][attr]
            if attr in ("base", "target"):
                a = renamed.get(a, a)
            if a == b:
                continue
            if a is None or b is None:
                out.append((name, attr, "added" if a is None else "removed"))
            else:
                out.append((name, attr, "retyped" if a.startswith("[") != b.startswith("[") else "changed"))
    for attr in ("type", "base", "data"):
        a, b = ({x["spelt"][attr] for x in side} - {None} for side in (old, new))
        if a and b and a != b:
            out.append(("*", attr, "renamed"))
    return out


def changes(files: DataFrame) -> DataFrame:
    """(file_id, layer, attr, change_kind): what each file changes against the preceding one of its series, from the consistent table.

    A header without readable layers counts as one without layers. Files that stand twice count once; an empty table has no changes.
    """
    each = consistent(files.dropDuplicates(["file_id"])).withColumn("x", F.struct("ord", "layer", *ATTRS, "spelt"))
    whole = cut(each.groupBy("file_id").agg(F.array_sort(F.collect_list("x")).alias("layers")))  # read twice, as a file and as the one before it
    order = preceding(files)
    pairs = order.join(whole, "file_id", "left").join(whole.select(F.col("file_id").alias("before"), F.col("layers").alias("earlier")), "before", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *x) for f, old, new in zip(*(c.to_pylist() for c in batch.columns)) for x in compare(old or [], new or [])]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["file_id", "layer", "attr", "change_kind"])

    return pairs.select("file_id", "earlier", "layers").mapInArrow(run, "file_id bigint, layer string, attr string, change_kind string")
