"""Database type names as Spark types, their ranges, and checks of literals against columns."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

_FACET = re.compile(r"^\s*([^()]+?)\s*(?:\(\s*(max|\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(unsigned)?\s*$", re.I)

# Names of database types by what holds their values.
NAMES = {
    "int": "int int4 integer serial serial4 mediumint year",
    "long": "bigint int8 bigserial serial8",
    "short": "smallint int2 smallserial serial2 tinyint",
    "string": "varchar text nvarchar ntext char nchar character citext tinytext mediumtext longtext enum set",
    "boolean": "bool boolean",
    "decimal": "decimal numeric money smallmoney",
    "double": "float,double precision,float8,double",
    "float": "real float4",
    "local": "datetime,timestamp,datetime2,smalldatetime,timestamp without time zone",
    "date": "date",
    "instant": "timestamp with time zone,timestamptz,datetimeoffset,time with time zone",
    "time": "time,time without time zone",
    "uuid": "uniqueidentifier uuid",
    "binary": "bytea varbinary binary image blob tinyblob mediumblob longblob",
    "json": "json jsonb",
    "address": "inet cidr",
}
_KIND = {name: kind for kind, names in NAMES.items() for name in (names.split(",") if "," in names else [names] if kind == "date" else names.split())}
_SPARK = {
    "int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "float": T.FloatType(), "local": T.TimestampNTZType(), "date": T.DateType(), "instant": T.TimestampType(),
    "uuid": T.StringType(), "binary": T.BinaryType(), "json": T.StringType(), "address": T.StringType(),
}
_RANGES = {"int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "short": (-(2**15), 2**15 - 1)}


def split_type(db_type: str) -> tuple[str, int | None, int | None, bool]:
    """(name, first facet, second facet, unsigned); ``max`` is -1."""
    m = _FACET.match(db_type)
    if not m:
        return db_type.strip().lower(), None, None, False
    first = -1 if m[2] and m[2].lower() == "max" else int(m[2]) if m[2] else None
    name = " ".join(m[1].lower().split())
    unsigned = bool(m[4]) or name.endswith(" unsigned")
    return name.removesuffix(" unsigned"), first, int(m[3]) if m[3] else None, unsigned


def kind_of(db_type: str, dialect: str = "") -> str | None:
    """What holds the values of a type; None if it is not known (the caller warns)."""
    name, first, _, unsigned = split_type(db_type)
    if name.endswith("[]"):
        return "array"
    if name in ("rowversion",) or name == "timestamp" and dialect == "sqlserver":
        return "version"
    if name == "bit":
        return "boolean" if (first or 1) <= 1 else None
    if name == "tinyint" and dialect == "mysql" and first == 1:
        return "boolean"
    if name == "tinyint" and dialect == "sqlserver":
        return "byte"
    if unsigned and dialect == "mysql":
        return {"int": "uint", "integer": "uint", "bigint": "ulong", "smallint": "ushort"}.get(name, _KIND.get(name))
    return _KIND.get(name)


def spark_type(db_type: str, dialect: str = "", precision: int | None = None, scale: int | None = None) -> T.DataType | None:
    name, p, s, _ = split_type(db_type)
    kind = kind_of(db_type, dialect)
    if kind == "array":
        inner = spark_type(db_type.strip()[:-2], dialect)
        return T.ArrayType(inner) if inner else None
    if kind == "decimal":
        if name in ("money", "smallmoney"):
            return T.DecimalType(19 if name == "money" else 10, 4)
        p, s = precision or p, scale if scale is not None else s
        return T.DecimalType(min(p, 38), s or 0) if p else T.DecimalType(38, 18)
    extra = {"version": T.LongType(), "byte": T.ShortType(), "uint": T.LongType(), "ulong": T.DecimalType(20, 0), "ushort": T.IntegerType()}
    if kind == "time":
        return T.TimeType(6) if hasattr(T, "TimeType") else T.StringType()
    return extra.get(kind) or _SPARK.get(kind)


def db_type_of(t: T.DataType) -> str:
    """The database name of a Spark type, for snapshots made from files."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return db_type_of(t.elementType) + "[]"
    plain = {
        T.IntegerType: "int", T.LongType: "bigint", T.ShortType: "smallint", T.ByteType: "smallint", T.StringType: "text", T.BooleanType: "boolean",
        T.DoubleType: "double precision", T.FloatType: "real", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp with time zone", T.DateType: "date", T.BinaryType: "bytea",
    }
    return plain.get(type(t), t.simpleString())


def integer_range(db_type: str, dialect: str) -> tuple[int, int] | None:
    name, first, _, unsigned = split_type(db_type)
    if name == "bit":
        return (0, 1) if dialect == "sqlserver" else (0, 2 ** (first or 1) - 1)
    if name == "year":
        return (1901, 2155)
    if name == "mediumint":
        return (0, 2**24 - 1) if unsigned else (-(2**23), 2**23 - 1)
    if name == "tinyint":
        return (0, 255) if dialect == "sqlserver" or unsigned else (-128, 127)
    kind = kind_of(db_type, dialect)
    if kind in ("uint", "ulong", "ushort"):
        return (0, {"uint": 2**32, "ulong": 2**64, "ushort": 2**16}[kind] - 1)
    return _RANGES.get(kind or "")


def literal_problem(text: str, is_text: bool, db_type: str, dialect: str, max_length: int | None = None, precision: int | None = None, scale: int | None = None) -> tuple[str, str] | None:
    """(code, message) if a literal cannot be a value of the column, else None."""
    name, first, second, _ = split_type(db_type)
    if is_text:
        most = max_length if max_length is not None else first if kind_of(db_type, dialect) == "string" else None
        if kind_of(db_type, dialect) != "string" or most is None or most < 0:
            return None
        size = len(text.encode("utf-16-le")) // 2 if dialect == "sqlserver" else len(text)
        return ("literal-length", f"{size} characters in {db_type} of {most}") if size > most else None
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    if name == "bit" and dialect == "postgres":
        return ("literal-kind", "a number is not a bit string")
    r = integer_range(db_type, dialect)
    if r:
        return None if r[0] <= value <= r[1] else ("literal-range", f"{text} is outside {r[0]}..{r[1]} of {db_type}")
    if kind_of(db_type, dialect) == "decimal":
        p, s = precision or first, scale if scale is not None else second or 0
        if p:
            digits = value.as_tuple()
            after = max(0, -digits.exponent)
            before = max(0, len(digits.digits) + digits.exponent) if value else 0
            if before > p - s or after > s:
                return ("literal-range", f"{text} does not fit decimal({p},{s})")
    return None
