"""Problem 2: nested archive responses to flat tables, by kernels on Arrow buffers.

A batch's list offsets give each child its parent's index; parents' keys follow by a vectorised
take. Only responses that did not fit the struct (text in ``raw``) are parsed as JSON; they are
brought into the same struct and go through the same kernels. ``child_table`` does the same for any
nested column, by its schema; ``unreadable`` lists the responses that give no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

TEXTS = ("Titel", "Inhoud", "hdl", "oldid", "timestamp", "Datering", "Inhoudsdatering", "Nummer_toegang")
FLAGS = ("auteursrechten_voorwaarde_CC_BY_SA", "auteursrechten_voorwaarde_webdisplay")
LISTS = ("Trefwoorden", "Geografisch_trefwoord", "Vervaardiger")

#: The flat tables and their columns.
TABLES = {
    "responses": "req_id bigint, num_found bigint, start bigint, n_docs int, origin string",
    "documents": "req_id bigint, doc_pos int, doc_id string, " + ", ".join(f"`{c}` string" for c in TEXTS) + ", " + ", ".join(f"`{c}` boolean" for c in FLAGS),
    "items": "req_id bigint, doc_pos int, doc_id string, field string, item_pos int, value string",
    "images": "req_id bigint, doc_pos int, doc_id string, image_key string, file_pos int, url string, width bigint, height bigint",
    "links": "req_id bigint, doc_id string, field string, item string",
}

_FILE = pa.struct([("url", pa.string()), ("width", pa.int64()), ("height", pa.int64())])
_DOC = pa.struct([("id", pa.string())] + [(c, pa.string()) for c in TEXTS] + [(c, pa.bool_()) for c in FLAGS] + [(c, pa.list_(pa.string())) for c in LISTS] + [("images", pa.map_(pa.string(), pa.list_(_FILE)))])
_RESPONSE = pa.struct([("numFound", pa.int64()), ("start", pa.int64()), ("docs", pa.list_(_DOC))])


# ---- text that did not fit the struct ---------------------------------------------------------


def _text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _whole(v):
    if isinstance(v, bool):
        return None
    try:
        n = int(str(v).strip())
    except ValueError:
        return int(v) if isinstance(v, float) and v.is_integer() else None
    return n if abs(n) < 1 << 63 else None


def _listed(v) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _files(v) -> list:
    return [{"url": _text(f.get("url")), "width": _whole(f.get("width")), "height": _whole(f.get("height"))} for f in _listed(v) if isinstance(f, dict)]


def _images(v):
    if isinstance(v, dict):
        return [(str(k), _files(x)) for k, x in v.items()]
    return [(_text(x.get("key")) or "", _files(x.get("files", x if "url" in x else None))) for x in _listed(v) if isinstance(x, dict)]


def _doc(d: dict) -> dict:
    out = {"id": _text(d.get("id")), "images": _images(d.get("images"))}
    out |= {c: _text(d.get(c)) for c in TEXTS} | {c: v if isinstance(v := d.get(c), bool) else None for c in FLAGS}
    return out | {c: [_text(x) for x in _listed(d.get(c))] for c in LISTS}


def read_raw(raw: str | None) -> dict | None:
    """The response in a JSON text, or None where it can't be read. The text may be JSON in a JSON
    string, the response may stand in an envelope, one document may stand for a list of one, one
    keyword for a list of one, and images may be a map or a list of keyed files."""
    try:
        v = json.loads(raw) if raw is not None else None
        for _ in range(3):
            if isinstance(v, str):
                v = json.loads(v)
    except (ValueError, RecursionError):
        return None
    for _ in range(4):
        if isinstance(v, dict) and not {"docs", "numFound", "start"} & v.keys():
            v = next((v[k] for k in ("response", "result") if isinstance(v.get(k), dict)), None)
    if not isinstance(v, dict):
        return None
    return {"numFound": _whole(v.get("numFound")), "start": _whole(v.get("start")), "docs": [_doc(d) for d in _listed(v.get("docs")) if isinstance(d, dict)]}


# ---- kernels ----------------------------------------------------------------------------------


def _fields(s: pa.Array) -> dict[str, pa.Array]:
    """Children of a struct array, null where the struct is."""
    return dict(zip((f.name for f in s.type), s.flatten()))


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Values of a list or map array, the index of the parent of each, and its place in the list."""
    if pa.types.is_map(lists.type):
        pairs = pa.StructArray.from_arrays([lists.keys, lists.items], names=["key", "value"])
        lists = pa.ListArray.from_arrays(lists.offsets, pairs)
    values, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return values, parent, pa.array(place, pa.int32())


def _const(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array([0] * n, pa.int32()))


def _kept(columns: list[pa.Array], ok: pa.Array) -> list[pa.Array]:
    return [c.filter(ok) for c in columns]


def _present(s: pa.Array) -> pa.Array:
    return pc.and_kleene(pc.is_valid(s), pc.fill_null(pc.not_equal(s, ""), False))


def flatten(req: pa.Array, response: pa.Array, origin: str, table: str) -> list[list[pa.Array]]:
    """Columns of one flat table, in blocks."""
    there = pc.is_valid(response)
    req, response = req.filter(there), response.filter(there)
    top = _fields(response)
    number = pc.cast(top["numFound"], pa.int64())
    if table == "responses":
        n = pc.cast(pc.fill_null(pc.list_value_length(top["docs"]), 0), pa.int32())
        return [[req, number, pc.cast(top["start"], pa.int64()), n, _const(origin, len(req))]]
    docs, parent, place = _children(top["docs"])
    doc_req, doc = req.take(parent), _fields(docs)
    if table == "documents":
        return [[doc_req, place, doc["id"], *(doc[c] for c in TEXTS + FLAGS)]]
    blocks = []
    if table == "links":
        blocks.append(_kept([req, _const("", len(req)), _const("numFound", len(req)), pc.cast(number, pa.string())], pc.is_valid(number)))
        blocks.append(_kept([doc_req, doc["id"], _const("docs", len(docs)), doc["id"]], _present(doc["id"])))
    if table in ("items", "links"):
        for field in LISTS:
            values, at, k = _children(doc[field])
            keys = [doc_req.take(at), place.take(at), doc["id"].take(at), _const(field, len(values)), k, values]
            blocks.append(_kept(keys if table == "items" else [keys[0], keys[2], keys[3], values], _present(values)))
    if table in ("images", "links"):
        pairs, at, _ = _children(doc["images"])
        pair = _fields(pairs)
        files, up, k = _children(pair["value"])
        at, file = at.take(up), _fields(files)
        if table == "images":
            blocks.append([doc_req.take(at), place.take(at), doc["id"].take(at), pair["key"].take(up), k, file["url"], pc.cast(file["width"], pa.int64()), pc.cast(file["height"], pa.int64())])
        else:
            blocks.append(_kept([doc_req.take(at), doc["id"].take(at), _const("images", len(files)), file["url"]], _present(file["url"])))
    return blocks


def flat_table(df: DataFrame, name: str, req_col: str = "req_id", response_col: str = "response", raw_col: str = "raw") -> DataFrame:
    """One of the flat tables (see TABLES) of a table of responses. No shuffle.

    ``items`` and ``links`` hold no null or empty values; ``images`` and ``documents`` hold every
    element. ``links`` holds each link of a response once. A response that is null and whose raw
    text can't be read gives no rows; null, missing and empty lists have no children. Other columns
    of ``df`` are not read, so their names can't clash."""
    ddl = TABLES[name]
    narrow = df.select(F.col(f"`{req_col}`").alias("req_id"), F.col(f"`{response_col}`").alias("response"), F.when(F.col(f"`{response_col}`").isNull(), F.col(f"`{raw_col}`")).alias("raw"))
    names = [c.strip().split(" ")[0].strip("`") for c in ddl.split(",")]

    def run(batches):
        for b in batches:
            req, response, raw = b.column(0), b.column(1), b.column(2)
            blocks = flatten(req, response, "typed", name)
            if raw.null_count < len(raw):
                at = pc.is_valid(raw)
                parsed = pa.array([read_raw(x) for x in raw.filter(at).to_pylist()], _RESPONSE)
                blocks += flatten(req.filter(at), parsed, "raw", name)
            for cols in blocks:
                if len(cols[0]):
                    t = pa.table(cols, names=names)
                    if name == "links":
                        t = t.group_by(names).aggregate([])
                    yield from t.to_batches()

    return narrow.mapInArrow(run, ddl)


def unreadable(df: DataFrame, req_col: str = "req_id", response_col: str = "response", raw_col: str = "raw") -> DataFrame:
    """(req_id, reason, raw) of the responses that give no rows: 'missing' without a struct and without
    text, 'unreadable' where the text can't be read. No shuffle."""
    narrow = df.filter(F.col(f"`{response_col}`").isNull()).select(F.col(f"`{req_col}`").alias("req_id"), F.col(f"`{raw_col}`").alias("raw"))

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            reason = ["missing" if x is None else None if read_raw(x) is not None else "unreadable" for x in raw]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(reason, pa.string()), b.column(1)], names=["req_id", "reason", "raw"])
            yield out.filter(pc.is_valid(out.column(1)))

    return narrow.mapInArrow(run, "req_id bigint, reason string, raw string")


# ---- any schema -------------------------------------------------------------------------------


def table_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all lists and maps of a type, outer ones first: each is a flat table."""
    out: list[str] = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            out += table_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out += [at, *table_paths(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType, f"{at}[]")]
    return sorted(out, key=lambda p: p.count("[]"))


def _leaves(kind: T.DataType, name: str) -> list[tuple[str, T.DataType]]:
    """Scalar columns of a table's element: structs are spelled out, lists and maps are tables of their own."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{name}_{f.name}" if name else f.name)]
    return [] if isinstance(kind, (T.ArrayType, T.MapType)) else [(name or "value", kind)]


def _element(kind: T.DataType, path: str) -> tuple[T.DataType, int, bool]:
    """The element's type at a path, how many lists lead there, and whether the last is a map."""
    depth, is_map = 0, False
    for part in path.split("."):
        while part.endswith("[]"):
            part = part[:-2] + "\0"
        name, marks = part.rstrip("\0"), part.count("\0")
        if name:
            kind = next(f.dataType for f in kind.fields if f.name == name)
        for _ in range(marks):
            is_map = isinstance(kind, T.MapType)
            kind, depth = kind.valueType if is_map else kind.elementType, depth + 1
    is_map = isinstance(kind, T.MapType)
    return kind.valueType if is_map else kind.elementType, depth + 1, is_map


def child_table(df: DataFrame, key_col: str, column: str, path: str) -> DataFrame:
    """The flat table of one list or map of a nested column, of whatever schema: the row's key, the
    place in each list on the way (pos_1, pos_2, ...), the map's key, and the element's scalar fields.
    ``path`` is one of ``table_paths`` of the column's type: names with '.', '[]' for a list or map that
    is gone through. Null, missing and empty lists have no children; null elements come out as nulls."""
    kind = df.schema[column].dataType
    element, depth, is_map = _element(kind, path)
    leaves = _leaves(element, "")
    taken = {key_col, "map_key"} | {f"pos_{i}" for i in range(1, depth + 1)}
    names = [n if n not in taken else f"{n}_" for n, _ in leaves]
    fields = [T.StructField(key_col, df.schema[key_col].dataType), *[T.StructField(f"pos_{i}", T.IntegerType()) for i in range(1, depth + 1)], *([T.StructField("map_key", T.StringType())] if is_map else []), *[T.StructField(n, t) for n, (_, t) in zip(names, leaves)]]
    steps = path.replace("[]", ".[]").split(".")

    def flat(x: pa.Array, prefix: str = "") -> list[pa.Array]:
        if pa.types.is_struct(x.type):
            return [c for name, v in _fields(x).items() for c in flat(v)]
        return [] if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) or pa.types.is_map(x.type) else [x]

    def run(batches):
        for b in batches:
            keys, x, places, map_key = b.column(0), b.column(1), [], None
            for step in [*steps, "[]"]:
                if step != "[]":
                    x = _fields(x)[step]
                    continue
                if pa.types.is_large_list(x.type):
                    x = x.cast(pa.list_(x.type.value_type))
                through_map = pa.types.is_map(x.type)
                x, parent, place = _children(x)
                keys, places = keys.take(parent), [*[p.take(parent) for p in places], place]
                if through_map:
                    pair = _fields(x)
                    map_key, x = pair["key"], pair["value"]
            columns = [keys, *places, *([map_key] if is_map else []), *flat(x)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(key_col, column).mapInArrow(run, T.StructType(fields))
