"""Input tables: fixed logical columns from nested or dotted physical ones, with casts, defaults and checks."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("wayfare")

ID, DOUBLE, STRING, BOOL, IDS, DOUBLES = "id", "double", "string", "boolean", "array<id>", "array<double>"
_UTILITY = {f"{{p}}.{k}": DOUBLE for k in ("one", "two", "three", "four")}
_SCHEDULE = {"{p}.type": STRING} | {f"{{p}}.{k}": DOUBLE for k in ("tstar", "beta", "gamma", "delta")}


def _under(prefix: str, columns: dict[str, str]) -> dict[str, str]:
    return {c.format(p=prefix): t for c, t in columns.items()}


def _choice(prefix: str) -> dict[str, str]:
    return {f"{prefix}.type": STRING, f"{prefix}.u": DOUBLE, f"{prefix}.mu": DOUBLE, f"{prefix}.constants": DOUBLES}


#: Logical columns of each table: (types, keys, required).
TABLES: dict[str, tuple[dict[str, str], list[str], list[str]]] = {
    "agents": ({"agent_id": ID} | _choice("alt_choice"), ["agent_id"], ["agent_id"]),
    "alternatives": (
        {"agent_id": ID, "alt_id": ID, "origin_delay": DOUBLE, "dt_choice.type": STRING, "dt_choice.departure_time": DOUBLE, "dt_choice.period": DOUBLES, "dt_choice.interval": DOUBLE, "dt_choice.offset": DOUBLE}
        | _choice("dt_choice.model")
        | {"constant_utility": DOUBLE, "alpha": DOUBLE}
        | _under("total_travel_utility", _UTILITY)
        | _under("origin_utility", _SCHEDULE)
        | _under("destination_utility", _SCHEDULE)
        | {"pre_compute_route": BOOL},
        ["agent_id", "alt_id"],
        ["agent_id", "alt_id"],
    ),
    "trips": (
        {"agent_id": ID, "alt_id": ID, "trip_id": ID, "class.type": STRING, "class.origin": ID, "class.destination": ID, "class.vehicle": ID, "class.route": IDS, "class.travel_time": DOUBLE, "stopping_time": DOUBLE, "constant_utility": DOUBLE, "alpha": DOUBLE}
        | _under("travel_utility", _UTILITY)
        | _under("schedule_utility", _SCHEDULE),
        ["agent_id", "alt_id", "trip_id"],
        ["agent_id", "alt_id", "trip_id", "class.type"],
    ),
    "edges": (
        {"edge_id": ID, "source": ID, "target": ID, "speed": DOUBLE, "length": DOUBLE, "lanes": DOUBLE}
        | {"speed_density.type": STRING}
        | {f"speed_density.{k}": DOUBLE for k in ("capacity", "min_density", "jam_density", "jam_speed", "beta")}
        | {"bottleneck_flow": DOUBLE, "bottleneck_flows": DOUBLES, "bottleneck_times": DOUBLES, "constant_travel_time": DOUBLE, "overtaking": BOOL},
        ["edge_id"],
        ["edge_id", "source", "target", "speed", "length"],
    ),
    "vehicle_types": (
        {"vehicle_id": ID, "headway": DOUBLE, "pce": DOUBLE, "speed_function.type": STRING, "speed_function.upper_bound": DOUBLE, "speed_function.coef": DOUBLE, "speed_function.x": DOUBLES, "speed_function.y": DOUBLES, "allowed_edges": IDS, "restricted_edges": IDS},
        ["vehicle_id"],
        ["vehicle_id", "headway"],
    ),
    "road_network_conditions": ({"vehicle_id": ID, "edge_id": ID, "departure_time": DOUBLE, "travel_time": DOUBLE}, ["vehicle_id", "edge_id", "departure_time"], ["vehicle_id", "edge_id", "departure_time", "travel_time"]),
    "routing_edges": ({"edge_id": ID, "source": ID, "target": ID, "travel_time": DOUBLE}, ["edge_id"], ["edge_id", "source", "target"]),
    "edge_ttfs": ({"edge_id": ID, "departure_time": DOUBLE, "travel_time": DOUBLE}, ["edge_id", "departure_time"], ["edge_id", "departure_time", "travel_time"]),
    "input_order": ({"node_id": ID, "order": ID}, ["node_id"], ["node_id", "order"]),
    "queries": ({"query_id": ID, "origin": ID, "destination": ID, "departure_time": DOUBLE}, ["query_id"], ["query_id", "origin", "destination"]),
}

#: Values where a column is null.
DEFAULTS: dict[str, dict[str, object]] = {
    "alternatives": {"origin_delay": 0.0, "constant_utility": 0.0, "alpha": 0.0, "pre_compute_route": True, "dt_choice_offset": 0.0},
    "trips": {"stopping_time": 0.0, "constant_utility": 0.0, "alpha": 0.0},
    "edges": {"lanes": 1.0, "constant_travel_time": 0.0, "overtaking": True, "speed_density_type": "FreeFlow"},
    "vehicle_types": {"pce": 1.0, "speed_function_type": "Base"},
    "routing_edges": {"travel_time": 1.0},
}

#: Conditions on rows: (condition that must not be false, message).
RULES: dict[str, list[tuple[str, str]]] = {
    "agents": [
        ("alt_choice_type is null or alt_choice_type in ('Logit', 'Deterministic', 'First')", "unknown alt_choice.type"),
        ("alt_choice_type <> 'Logit' or (alt_choice_u is not null and alt_choice_mu is not null)", "a Logit choice needs u and mu"),
        ("alt_choice_u between 0 and 1", "u must be within 0 and 1"),
        ("alt_choice_mu > 0", "mu must be positive"),
    ],
    "alternatives": [
        ("origin_delay >= 0", "origin_delay must not be negative"),
        ("dt_choice_type is null or dt_choice_type in ('Constant', 'Discrete', 'Continuous')", "unknown dt_choice.type"),
        ("dt_choice_type <> 'Constant' or dt_choice_departure_time >= 0", "a constant departure needs a departure_time of 0 or more"),
        ("dt_choice_type <> 'Discrete' or dt_choice_interval > 0", "a discrete departure needs a positive interval"),
        ("dt_choice_type <> 'Continuous' or dt_choice_model_type = 'Logit'", "a continuous departure needs a Logit model"),
        ("dt_choice_model_type is null or dt_choice_model_type in ('Logit', 'Deterministic', 'First')", "unknown dt_choice.model.type"),
        ("dt_choice_type not in ('Discrete', 'Continuous') or dt_choice_model_type <> 'Logit' or (dt_choice_model_u is not null and dt_choice_model_mu is not null)", "a Logit model needs u and mu"),
        ("dt_choice_type <> 'Continuous' or dt_choice_model_type is not null", "a continuous departure needs a Logit model"),
        ("size(dt_choice_period) = 2 and dt_choice_period[0] < dt_choice_period[1]", "dt_choice.period must be a start and a later end"),
        ("dt_choice_model_u between 0 and 1", "u must be within 0 and 1"),
        ("dt_choice_model_mu > 0", "mu must be positive"),
        ("origin_utility_type is null or origin_utility_tstar >= coalesce(origin_utility_delta, 0) / 2", "tstar must be delta / 2 or more"),
        ("destination_utility_type is null or destination_utility_tstar >= coalesce(destination_utility_delta, 0) / 2", "tstar must be delta / 2 or more"),
    ],
    "trips": [
        ("class_type in ('Road', 'Virtual')", "class.type must be Road or Virtual"),
        ("class_type <> 'Road' or (class_origin is not null and class_destination is not null and class_vehicle is not null)", "a road trip needs origin, destination and vehicle"),
        ("class_travel_time >= 0", "travel_time must not be negative"),
        ("stopping_time >= 0", "stopping_time must not be negative"),
        ("schedule_utility_type is null or schedule_utility_tstar >= coalesce(schedule_utility_delta, 0) / 2", "tstar must be delta / 2 or more"),
    ],
    "edges": [
        ("speed > 0", "speed must be positive"),
        ("length >= 0", "length must not be negative"),
        ("lanes > 0", "lanes must be positive"),
        ("constant_travel_time >= 0", "constant_travel_time must not be negative"),
        ("speed_density_type in ('FreeFlow', 'Bottleneck', 'ThreeRegimes')", "unknown speed_density.type"),
        ("speed_density_type <> 'Bottleneck' or (speed_density_capacity is not null and speed_density_capacity > 0)", "a bottleneck needs a positive capacity"),
        ("speed_density_type <> 'ThreeRegimes' or (speed_density_min_density is not null and speed_density_jam_density is not null and speed_density_jam_speed is not null and speed_density_beta is not null)", "three regimes need min_density, jam_density, jam_speed and beta"),
        ("speed_density_type <> 'ThreeRegimes' or speed_density_jam_density >= speed_density_min_density", "jam_density must be min_density or more"),
        ("bottleneck_flow > 0", "bottleneck_flow must be positive"),
        ("size(bottleneck_flows) = size(bottleneck_times)", "bottleneck_flows and bottleneck_times must have one length"),
    ],
    "vehicle_types": [
        ("headway >= 0", "headway must not be negative"),
        ("pce >= 0", "pce must not be negative"),
        ("speed_function_type in ('Base', 'UpperBound', 'Multiplicator', 'Piecewise')", "unknown speed_function.type"),
        ("speed_function_type <> 'UpperBound' or speed_function_upper_bound > 0", "an upper bound must be positive"),
        ("speed_function_type <> 'Multiplicator' or speed_function_coef > 0", "a coefficient must be positive"),
        ("speed_function_type <> 'Piecewise' or (size(speed_function_x) = size(speed_function_y) and size(speed_function_x) > 0 and speed_function_x = array_sort(speed_function_x))", "x must be sorted and as long as y"),
    ],
    "road_network_conditions": [("travel_time >= 0", "travel_time must not be negative")],
    "routing_edges": [("travel_time >= 0", "travel_time must not be negative")],
}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by extension, with the rows' place in ``row_index``."""
    kind = os.path.splitext(path.rstrip("/"))[1]
    if kind == ".parquet":
        table = spark.read.parquet(path)
        return table.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("row_index"))
    if kind == ".csv":
        # order is meaning here: rows are counted within the piece of the file that a task reads, and pieces are told apart by where they begin
        table = spark.read.option("header", True).option("inferSchema", True).csv(path)
        piece = F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
        return table.select("*", F.struct(piece.alias("file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")).alias("row_index"))
    raise ValueError(f"{path}: only .parquet and .csv files can be read")


def read_json(path: str):
    """JSON, or JSON in zstandard; a URI is read by Spark's file systems."""
    if "://" in path:
        from wayfare.sources import sinks

        return sinks.read_json_file(SparkSession.active(), path)
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return json.loads(data)


def resolve(table: DataFrame, name: str) -> Column | None:
    """Column ``a.b`` as a flat column of that name, or as field b of struct a."""
    if name in table.columns:
        return F.col(f"`{name}`")
    kind: T.DataType = table.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return F.col(name)


def _cast(column: Column, kind: T.DataType, wanted: str) -> Column:
    if wanted == ID:
        return column.cast("bigint") if isinstance(kind, T.IntegralType | T.DecimalType) else column.cast("string")
    if wanted == IDS:
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        column = column.cast("array<bigint>" if isinstance(inner, T.IntegralType | T.DecimalType | T.NullType) else "array<string>")
    else:
        column = column.cast(wanted)
    return F.when(~F.exists(column, lambda x: x.isNull()), column) if wanted.startswith("array") else column


def unused(table: DataFrame, known: dict[str, str]) -> list[str]:
    """Physical columns, with fields of structs, that no logical one names."""
    found = []

    def walk(schema: T.StructType, prefix: str) -> None:
        for f in schema.fields:
            name = prefix + f.name
            if name in known:
                continue
            if isinstance(f.dataType, T.StructType) and any(k.startswith(name + ".") for k in known):
                walk(f.dataType, name + ".")
            elif name != "row_index":
                found.append(name)

    walk(table.schema, "")
    return found


def read(table: DataFrame, name: str) -> DataFrame:
    """The logical table ``name``: dots become underscores, defaults are filled, rules hold for every row or the query fails."""
    out, problem = _logical(table, name)
    key = TABLES[name][1][0]
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast(out.schema[key].dataType)).otherwise(F.col(key))
    return out.withColumn(key, checked)


def problems(table: DataFrame, name: str) -> DataFrame:
    """Keys and the first broken rule of the rows that ``read`` would fail for."""
    out, problem = _logical(table, name)
    return out.select(*TABLES[name][1], problem.alias("problem")).where("problem is not null")


def _logical(table: DataFrame, name: str) -> tuple[DataFrame, Column]:
    types, _, required = TABLES[name]
    if "row_index" not in table.columns:
        table = table.withColumn("row_index", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))
    for column in unused(table, types):
        log.warning("%s: the column %s is not used", name, column)
    columns = []
    for column, wanted in types.items():
        found = resolve(table, column)
        if found is None:
            if column in required:
                raise ValueError(f"{name}: the column {column} is missing")
            found = F.lit(None).cast("bigint" if wanted == ID else wanted.replace("id", "bigint"))
        else:
            found = _cast(found, table.select(found.alias("x")).schema["x"].dataType, wanted)
        label = column.replace(".", "_")
        default = DEFAULTS.get(name, {}).get(label)
        columns.append((found if default is None else F.coalesce(found, F.lit(default))).alias(label))
    out = table.select(*columns, "row_index")
    problem = F.lit(None).cast("string")
    for condition, message in reversed([*RULES.get(name, []), *((f"{c.replace('.', '_')} is not null", f"{c} must not be null") for c in required)]):
        problem = F.when(F.expr(f"not coalesce({condition}, true)"), F.lit(f"{name}: {message}")).otherwise(problem)
    return out, problem


def duplicates(table: DataFrame, name: str) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*TABLES[name][1]).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(table: DataFrame, name: str) -> None:
    found = duplicates(table, name).limit(10).collect()
    if found:
        raise ValueError(f"{name}: duplicate keys, such as {[tuple(r)[:-1] for r in found]}")


def require_known(values: DataFrame, known: DataFrame, message: str) -> None:
    """Fails with the first ten values (one column) that are not among the known ones."""
    (a,), (b,) = values.columns, known.columns
    missing = values.where(F.col(a).isNotNull()).join(known.select(F.col(b).alias(a)), a, "left_anti").distinct().limit(10).collect()
    if missing:
        raise ValueError(f"{message}: {[r[0] for r in missing]}")


def require_rows(table: DataFrame, name: str) -> None:
    if table.isEmpty():
        raise ValueError(f"{name}: the table is empty")
