"""JSON handling for the schemaless columns (§1.3).

Rules:
* objects are parsed to ``map<string,string>`` (never ``map<string,double>``,
  which nulls the whole map when one value is text) and values are cast
  one by one;
* ``posexplode`` keeps the key order of the text, which tie rules need;
* a key repeated in one object keeps its *last* value, like Python's
  ``json.loads``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT_AS_TEXT_MAP = "map<string,string>"


def object_entries(df: DataFrame, json_col: str, keep: list[str],
                   key_name: str = "key", value_name: str = "raw_value",
                   pos_name: str = "pos") -> DataFrame:
    """Explode a JSON object column into ``(keep..., pos, key, raw_value)``.

    ``pos`` is the 0-based position of the key in the text. A repeated key
    keeps its last occurrence (and that occurrence's position). Text that is
    not an object gives no entries. Everything is a per-row expression: no
    shuffle is needed to drop duplicate keys."""
    return df.select(*keep, F.inline(object_entry_array(json_col, key_name, value_name, pos_name)))


def object_entry_array(json_col: str, key_name: str = "key", value_name: str = "raw_value",
                       pos_name: str = "pos") -> Column:
    """The entries of :func:`object_entries` as one array column
    ``array<struct<pos, key, value>>`` (empty for non-objects)."""
    entries = F.map_entries(F.from_json(F.col(json_col), OBJECT_AS_TEXT_MAP))
    numbered = F.transform(entries, lambda e, i: F.struct(
        i.alias(pos_name), e["key"].alias(key_name), e["value"].alias(value_name)))
    # The one-element array binds the parsed entries to a variable: used
    # inside the inner lambdas directly, they would be parsed for each entry.
    last_only = F.transform(F.array(numbered), lambda all_: F.filter(all_, lambda e: ~F.exists(
        F.slice(all_, e[pos_name] + 2, F.greatest(F.size(all_), F.lit(1))),
        lambda later: later[key_name] == e[key_name])))[0]
    return F.coalesce(last_only, F.array().cast(
        f"array<struct<{pos_name}:int,{key_name}:string,{value_name}:string>>"))


def json_field(json_col, path: str) -> Column:
    """Raw JSON text of one field (``$.a.b``), NULL when absent."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.get_json_object(c, path)


def is_object_text(c: Column) -> Column:
    """True when the text is a JSON object (``from_json`` of plain text
    yields a struct of NULLs, so test the leading brace instead)."""
    return F.ltrim(c).startswith("{")


def object_map(json_col: str) -> Column:
    """A JSON object as ``map<string,string>`` with the last-wins rule; NULL
    where the column is NULL."""
    entries = F.transform(object_entry_array(json_col), lambda e: F.struct(e["key"], e["raw_value"]))
    return F.when(F.col(json_col).isNotNull(), F.map_from_entries(entries))
