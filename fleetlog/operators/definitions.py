"""Message definitions as tables: lines, sections, fields, errors, resolved types, schemas."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Builtin types with their Spark types; fixed values. Unsigned types are widened.
BUILTIN = {
    "bool": "boolean", "byte": "tinyint", "char": "smallint", "int8": "tinyint", "uint8": "smallint",
    "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint",
    "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "string": "string", "wstring": "string",
    "time": "struct<secs:bigint,nsecs:bigint>", "duration": "struct<secs:int,nsecs:int>",
}
#: Smallest and largest values of integer types; fixed values.
RANGES = {
    "byte": (-128, 255), "char": (0, 255), "int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767), "uint16": (0, 65535),
    "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1),
}
FLOAT32 = 3.4028235e38

NAME = r"[A-Za-z][A-Za-z0-9_/]*"
#: type, array, field name, and what follows.
FIELD = rf"^\s*({NAME}(?:<=\d+)?)(\[(?:<=)?\d*\])?\s+([A-Za-z][A-Za-z0-9_]*)\s*(.*)$"
TYPE = r"^MSG:\s*(\S+)"
CONSTANT = rf"^\s*({NAME}(?:<=\d+)?)\s+([A-Za-z][A-Za-z0-9_]*)\s*=\s*(.*)$"


def is_separator(line: Column) -> Column:
    return line.startswith("===") & line.rlike(r"^={3,}\s*$")


def is_type(line: Column) -> Column:
    return line.startswith("MSG:") & line.rlike(TYPE)


def kind_of(line: Column) -> Column:
    """A plain look at characters comes before each pattern that only few lines can fit."""
    base = F.regexp_extract(line, rf"^\s*({NAME})", 1)
    return (
        F.when(F.trim(line) == "", "empty")
        .when(line.contains("#") & line.rlike(r"^\s*#"), "comment")
        .when(is_separator(line), "separator")
        .when(is_type(line), "type")
        .when(line.contains("=") & line.rlike(CONSTANT), "constant")
        .when(line.rlike(FIELD), F.when(base.isin(*BUILTIN), "builtin").otherwise("complex"))
        .otherwise("invalid")
    )


def with_kind(lines: DataFrame) -> DataFrame:
    """``lines`` with their kind. It comes from an array of one, as Spark would move a filter on a plain column below it
    and match all its patterns twice."""
    return lines.select("*", F.explode_outer(F.array(kind_of(F.col("line")))).alias("kind"))


def definition_lines(texts: DataFrame) -> DataFrame:
    """(text_id, line_no, line, kind) of ``texts`` (text_id, text)."""
    # The outer form, as Spark would split once more to see that there are lines.
    made = texts.filter("text IS NOT NULL").select("text_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return with_kind(made)


def sectioned_texts(texts: DataFrame) -> DataFrame:
    """``definition_sections`` of whole ``texts`` (text_id, text), and the text's sections with a type as ``known``. A text
    is cut within its row, so nothing is sorted or shuffled."""
    cut = texts.filter("text IS NOT NULL").select("text_id", F.split("text", "\n", -1).alias("lines"))
    first = F.filter(F.transform("lines", lambda x, i: F.when(is_separator(x), i)), lambda i: i.isNotNull())
    cut = cut.withColumn("starts", F.concat(F.array(F.lit(0)), first))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    own = F.transform("starts", lambda a, k: F.struct(k.alias("at"), a.alias("start"), F.slice("lines", a + 1, end(k) - a).alias("own")))
    named = lambda x: F.array_max(F.transform(F.filter(x["own"], is_type), lambda line: F.regexp_extract(line, TYPE, 1)))
    cut = cut.select("text_id", F.transform(own, lambda x: x.withField("target", named(x))).alias("sections"))
    known = F.filter(F.transform("sections", lambda x: F.struct(x["at"].alias("at"), x["target"].alias("target"))), lambda x: x["target"].isNotNull())
    parts = cut.withColumn("known", known).select("text_id", "known", F.explode_outer("sections").alias("x"))
    lines = parts.select("text_id", "known", F.col("x.at").alias("section"), F.col("x.target").alias("section_type"), F.col("x.start").alias("start"), F.posexplode_outer("x.own").alias("i", "line"))
    lines = lines.filter("i IS NOT NULL").withColumn("line_no", F.col("start") + F.col("i"))
    return with_kind(lines).select("text_id", "line_no", "line", "kind", "section", "section_type", "known")


def definition_sections(lines: DataFrame) -> DataFrame:
    """``lines`` with the section they belong to, and its type (NULL in section 0, the main message). For lines from
    anywhere; ``sectioned_texts`` does it for whole texts without a sort."""
    w = Window.partitionBy("text_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    made = lines.withColumn("section", F.sum((F.col("kind") == "separator").cast("int")).over(w).cast("int"))
    named = F.max(F.when(F.col("kind") == "type", F.regexp_extract("line", TYPE, 1)))
    return made.withColumn("section_type", named.over(Window.partitionBy("text_id", "section")))


def without_comment(line: Column) -> tuple[Column, Column]:
    """The line up to a # that is outside quotes, and the comment's text or NULL."""
    # Possessive, so that a long line doesn't need a deep stack; most lines hold none of the three.
    code = F.when(~(line.contains("#") | line.contains('"') | line.contains("'")), line).otherwise(F.regexp_extract(line, r"""^((?:[^#"']++|"[^"]*+"|'[^']*+')*+)""", 1))
    rest = F.substring(line, F.length(code) + 1, F.length(line))
    return F.rtrim(code), F.when(rest.startswith("#"), F.trim(F.substring(rest, F.lit(2), F.length(rest))))


def definition_fields(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Type, array kind and size, string bound, default or constant value, and comment of each field; of ``lines``' other
    columns those to ``keep``."""
    code, comment = without_comment(F.col("line"))
    made = lines.filter(F.col("kind").isin("constant", "builtin", "complex")).withColumns({"code": code, "comment": comment})
    # All groups of one match, apart by a character that none but the last, the value, can hold.
    groups = lambda pattern, wanted: F.regexp_replace("code", pattern + r"[\s\S]*", "\0".join(wanted))
    matched = F.when(F.col("kind") == "constant", groups(CONSTANT, ("$1", "", "$2", "$3"))).otherwise(groups(FIELD, ("$1", "$2", "$3", "$4")))
    made = made.withColumn("parts", F.split(matched, "\0", 4))
    part = lambda i: F.when(F.size("parts") == 4, F.get("parts", F.lit(i))).otherwise("")
    made = made.withColumns({"full": part(0), "array": part(1), "name": part(2), "value": part(3)})
    digits = lambda c, mark, pattern: F.when(c.contains(mark), F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    number = lambda *args: F.try_to_number(digits(*args), F.lit("9999999999")).cast("long")
    return made.select(
        "text_id",
        "section",
        "section_type",
        "line_no",
        "kind",
        F.substring_index("full", "<=", 1).alias("type"),
        number(F.col("full"), "<=", r"<=(\d+)$").alias("string_bound"),
        F.when(F.col("array") == "", "none").when(F.col("array") == "[]", "unbounded").when(F.col("array").contains("<="), "bounded").otherwise("fixed").alias("array"),
        number(F.col("array"), "[", r"(\d+)").alias("array_size"),
        "name",
        F.nullif(F.trim("value"), F.lit("")).alias("value"),
        "comment",
        *keep,
    )


def list_items(value: Column) -> Column:
    """Items of ``[a, b]``, else the value alone."""
    inner = F.trim(F.regexp_extract(value, r"^\[(.*)\]$", 1))
    return F.when(value.startswith("[") & value.rlike(r"^\[.*\]$"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x)))).otherwise(F.array(value))


def definition_errors(fields: DataFrame) -> DataFrame:
    """A row for each rule a field breaks."""
    wide = fields.withColumn("items", F.when(F.col("value").isNotNull(), list_items(F.col("value"))))
    bound = lambda i: F.create_map(*(x for k, v in RANGES.items() for x in (F.lit(k), F.lit(Decimal(v[i])).cast("decimal(20,0)"))))[F.col("type")]
    low, high = bound(0), bound(1)
    outside = F.exists("items", lambda x: F.coalesce((x.try_cast("decimal(20,0)") < low) | (x.try_cast("decimal(20,0)") > high), F.lit(True)))
    bare = lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")
    rules = {
        "array size must be above 0": F.col("array").isin("fixed", "bounded") & (F.col("array_size") <= 0),
        "string bound must be above 0": F.col("string_bound") <= 0,
        "integer out of range": low.isNotNull() & F.col("items").isNotNull() & outside,
        "float32 out of range": (F.col("type") == "float32") & F.exists("items", lambda x: F.coalesce(F.abs(x.try_cast("double")) > FLOAT32, F.lit(True))),
        "default has the wrong length": ((F.col("array") == "fixed") & (F.size("items") != F.col("array_size"))) | ((F.col("array") == "bounded") & (F.size("items") > F.col("array_size"))),
        "string longer than its bound": F.col("string_bound").isNotNull() & F.exists("items", lambda x: F.length(bare(x)) > F.col("string_bound")),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule & (F.col("items").isNotNull() | F.lit(not name.startswith(("default", "string longer")))), F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    # A field without value, array and bound breaks no rule. As a filter this would be moved below the parsing, and repeat it.
    some = F.col("items").isNotNull() | (F.col("array") != "none") | F.col("string_bound").isNotNull()
    return wide.select("text_id", "line_no", "name", F.explode_outer(F.when(some, broken)).alias("error")).filter("error IS NOT NULL")


def target_of(t: Column, section_type: Column, known: Column, version: int) -> Column:
    """(rule, at, target) of the first rule that fits, or NULL. ``known``: an array of sections (at, target)."""
    space = F.regexp_replace(section_type, "/[^/]*$", "")
    name = F.substring_index(t, "/", -1)
    builtin = F.lit(version == 2) & t.isin("Time", "Duration", "builtin_interfaces/Time", "builtin_interfaces/Duration")
    with_msg = F.when(F.lit(version == 2), F.regexp_replace(t, "^([^/]+)/([^/]+)$", "$1/msg/$2"))

    def ruled(x: Column) -> Column:
        target = x["target"]
        rules = [
            target == t,
            (t == "Header") & target.isin("std_msgs/Header", "std_msgs/msg/Header"),
            builtin & (target.startswith("builtin_interfaces/")) & (F.substring_index(target, "/", -1) == name),
            target == with_msg,
            target == F.concat(space, F.lit("/"), t),
            target.endswith(F.concat(F.lit("/"), t)),
        ]
        rule = F.coalesce(*(F.when(r, F.lit(i + 1)) for i, r in enumerate(rules)))
        return F.struct(rule.alias("rule"), x["at"].alias("at"), target.alias("target"))

    return F.array_min(F.filter(F.transform(known, ruled), lambda x: x["rule"].isNotNull()))


def resolved(asked: DataFrame, version: int) -> DataFrame:
    """``asked``: (text_id, line_no, type, section_type, known)."""
    best = target_of(F.col("type"), F.col("section_type"), F.col("known"), version)
    made = asked.select("text_id", "line_no", "type", best.alias("best")).select("text_id", "line_no", "type", F.col("best.target").alias("target"), F.col("best.rule").alias("rule"))
    return made.withColumn("error", F.when(F.col("target").isNull(), F.concat(F.lit("unresolved type "), "type")))


def resolve_types(fields: DataFrame, sections: DataFrame, version: int = 2) -> DataFrame:
    """The section a complex field's type stands for, by the first rule that fits; else an error.
    ``sections``: all lines with theirs, as a dependency may have no fields.

    Rules: the exact name; Header; time and duration (2); pkg/T as pkg/msg/T (2); the same namespace;
    the first dependency that ends in /T.
    """
    asked = fields.filter("kind = 'complex'").select("text_id", "line_no", "type", "section_type")
    section = F.struct(F.col("section").alias("at"), F.col("section_type").alias("target"))
    known = sections.filter("section_type IS NOT NULL").groupBy("text_id").agg(F.collect_set(section).alias("known"))
    return resolved(asked.join(known, "text_id", "left"), version)


def resolve_texts(lines: DataFrame, version: int = 2) -> DataFrame:
    """``resolve_types`` of ``sectioned_texts``, whose rows hold their text's sections: nothing is joined."""
    return resolved(definition_fields(lines.filter("kind = 'complex'"), keep=("known",)), version)


def to_struct(fields: DataFrame, resolved: DataFrame, text_id: str) -> T.StructType:
    """The schema of one definition (a bounded catalog, collected): nested structs, arrays, constants
    as fields with ``default`` metadata."""
    rows = fields.filter(F.col("text_id") == text_id).join(resolved.select("text_id", "line_no", "target"), ["text_id", "line_no"], "left").orderBy("line_no").collect()

    def build(section: str | None, path: tuple[str, ...]) -> T.StructType:
        if section in path:
            raise ValueError(f"{section} holds itself")
        made = []
        for r in rows:
            if r["section_type"] != section:
                continue
            kind = T.DataType.fromDDL(BUILTIN[r["type"]]) if r["type"] in BUILTIN else build(r["target"], (*path, section) if section else path)
            meta = {k: v for k, v in (("description", r["comment"]), ("default", r["value"])) if v}
            if r["array"] != "none":
                kind = T.ArrayType(kind)
                meta |= {"size": r["array_size"]} if r["array_size"] else {}
            made.append(T.StructField(r["name"], kind, True, meta))
        return T.StructType(made)

    return build(None, ())


def camel_case(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.translate(name, "_", " ")), " ", "")


def lookup_definition(topics: DataFrame, definitions: DataFrame) -> DataFrame:
    """The definition of each (topic, type_name, version): ``definitions`` (version, folder, file,
    text), the base folder before ``versioned``; none → NULL."""
    wanted = topics.withColumn("file", F.concat(camel_case(F.col("type_name")), F.lit(".msg")))
    place = F.when(F.col("folder").endswith("versioned"), 1).otherwise(0)
    best = definitions.groupBy("version", "file").agg(F.min_by("text", F.struct(place, "folder")).alias("definition"))
    return wanted.join(best, ["version", "file"], "left").select("topic", "type_name", "version", "definition")
