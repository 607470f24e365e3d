"""Tables of a folder of Parquet files, their keys, and catalog views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Primary keys of the known tables; lineitem has none.
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}


@dataclass
class TableSpec:
    """What the engine knows of a table beyond Spark's schema: Spark enforces neither keys nor defaults."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Catalog:
    """Registers the tables of a folder as temporary views and answers questions about them."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), KEYS if keys is None else keys

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def register(self, names: list[str] | None = None) -> Catalog:
        for name in names or self.keys:
            self.table(name).createOrReplaceTempView(name)
        return self

    def spec(self, name: str) -> TableSpec:
        return TableSpec(name, self.table(name).schema, self.keys.get(name, ()))

    def repeated_keys(self, name: str) -> DataFrame:
        """Keys that occur more than once, as nothing enforces them."""
        key = self.keys[name]
        return self.table(name).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1") if key else self.table(name).limit(0).select(F.lit(0).alias("n"))

    def columns(self, names: list[str] | None = None) -> DataFrame:
        """information_schema.columns: one row per column, from schemas only; no data is read."""
        rows = []
        for name in names or sorted(self.keys):
            for n, f in enumerate(self.table(name).schema, 1):
                rows.append((name, f.name, n, pg_type(f.dataType), self.keys.get(name, ()).index(f.name) + 1 if f.name in self.keys.get(name, ()) else 0))
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, key_position int")

    def tables(self) -> DataFrame:
        """information_schema.tables."""
        return self.system_view("information_schema_tables")

    def constraints(self) -> DataFrame:
        """information_schema.table_constraints: primary keys."""
        return self.system_view("information_schema_table_constraints")

    def key_columns(self) -> DataFrame:
        """information_schema.key_column_usage."""
        return self.system_view("information_schema_key_column_usage")

    def numbers(self) -> dict[str, int]:
        """The tables' numbers; a table's key constraint and index come FIRST_CONSTRAINT and FIRST_INDEX after."""
        return {n: FIRST_TABLE + k for k, n in enumerate(sorted(self.keys))}

    def definitions(self) -> dict[str, dict[int, str]]:
        """What the functions that look definitions up by number answer."""
        keyed = {n: oid for n, oid in self.numbers().items() if self.keys[n]}
        procs = {r["oid"]: r["proname"] for r in self._procs()}
        return {
            "tide_constraintdef": {oid + FIRST_CONSTRAINT: f"PRIMARY KEY ({', '.join(self.keys[n])})" for n, oid in keyed.items()},
            "tide_indexdef": {oid + FIRST_INDEX: f"CREATE UNIQUE INDEX {n}_pkey ON {n} ({', '.join(self.keys[n])})" for n, oid in keyed.items()},
            "tide_functiondef": {oid: f"CREATE OR REPLACE FUNCTION {name}()" for oid, name in procs.items()},
            "tide_function_arguments": dict.fromkeys(procs, ""),
        }

    def _procs(self) -> list[dict[str, object]]:
        names = sorted({f.name for f in self.spark.catalog.listFunctions() if not f.name.startswith("tide_")})
        return [{"oid": FIRST_PROC + k, "proname": n, "pronamespace": 11, "prokind": "f"} for k, n in enumerate(names)]

    def _rows(self, view: str) -> list[dict[str, object]]:
        """What a catalog view holds; only the schemas of tables are looked at, and only if the view needs them."""
        oid = self.numbers()
        keyed = {n: x for n, x in oid.items() if self.keys[n]}
        at = {"table_catalog": "main", "table_schema": "main"}
        named = {"constraint_catalog": "main", "constraint_schema": "main"}

        def fields() -> list[tuple[str, int, T.StructField]]:
            return [(n, k, f) for n in oid for k, f in enumerate(self.table(n).schema, 1)]

        def key_numbers(name: str) -> list[int]:
            columns = self.table(name).schema.names
            return [columns.index(c) + 1 for c in self.keys[name]]

        match view:
            case "information_schema_tables":
                return [at | {"table_name": n, "table_type": "BASE TABLE", "is_insertable_into": "YES"} for n in oid]
            case "information_schema_columns":
                return [at | {"table_name": n, "column_name": f.name, "ordinal_position": k, "is_nullable": "NO" if f.name in self.keys[n] else "YES", "data_type": pg_type(f.dataType), "udt_name": pg_type(f.dataType)} for n, k, f in fields()]
            case "information_schema_table_constraints":
                return [named | at | {"constraint_name": f"{n}_pkey", "table_name": n, "constraint_type": "PRIMARY KEY"} for n in keyed]
            case "information_schema_key_column_usage":
                return [named | at | {"constraint_name": f"{n}_pkey", "table_name": n, "column_name": c, "ordinal_position": k} for n in keyed for k, c in enumerate(self.keys[n], 1)]
            case "pg_class":
                return [{"oid": x, "relname": n, "relnamespace": 2200, "relkind": "r", "relpersistence": "p", "relhasindex": n in keyed, "relnatts": len(self.table(n).schema), "relispartition": False} for n, x in oid.items()]
            case "pg_attribute":
                by_name = {v: k for k, v in TYPE_OIDS.items()} | SHORT_OIDS
                return [{"attrelid": oid[n], "attname": f.name, "atttypid": by_name.get(pg_type(f.dataType), 25), "atttypmod": -1, "attnum": k, "attnotnull": f.name in self.keys[n], "atthasdef": False, "attisdropped": False, "atttype": pg_type(f.dataType)} for n, k, f in fields()]
            case "pg_type":
                return [{"oid": k, "typname": n, "typnamespace": 11, "typtype": "b", "typelem": 0, "typrelid": 0} for k, n in sorted(TYPE_OIDS.items())]
            case "pg_index":
                return [{"indexrelid": x + FIRST_INDEX, "indrelid": x, "indnatts": len(self.keys[n]), "indisunique": True, "indisprimary": True, "indisvalid": True, "indkey": key_numbers(n)} for n, x in keyed.items()]
            case "pg_constraint":
                return [{"oid": x + FIRST_CONSTRAINT, "conname": f"{n}_pkey", "connamespace": 2200, "contype": "p", "conrelid": x, "conindid": x + FIRST_INDEX, "conkey": key_numbers(n)} for n, x in keyed.items()]
            case "pg_namespace":
                return [{"oid": 11, "nspname": "pg_catalog"}, {"oid": 2200, "nspname": "main"}]
            case "pg_database":
                return [{"oid": 1, "datname": "main", "encoding": 6, "datistemplate": False, "datallowconn": True}]
            case "pg_am":
                return [{"oid": 2, "amname": "heap", "amtype": "t"}]
            case "pg_language":
                return [{"oid": 12, "lanname": "internal"}, {"oid": 14, "lanname": "sql"}]
            case "pg_proc":
                return self._procs()
        return []

    def system_view(self, name: str) -> DataFrame:
        """A view of information_schema (with that prefix) or pg_catalog; those that nothing fills are empty."""
        columns = VIEWS[name]
        rows = [tuple(r.get(c.split()[0]) for c in columns.split(", ")) for r in self._rows(name)]
        return self.spark.createDataFrame(rows, columns)

    def system_views(self) -> dict[str, DataFrame]:
        """The catalog emulation: information_schema and pg_catalog tables by name."""
        return {name: self.system_view(name) for name in VIEWS}


#: Where numbers of tables and functions begin, and how far those of keys lie after their tables'.
FIRST_TABLE, FIRST_CONSTRAINT, FIRST_INDEX, FIRST_PROC = 16384, 100_000, 200_000, 1000
_CONSTRAINT = "constraint_catalog string, constraint_schema string, constraint_name string"
_TABLE = "table_catalog string, table_schema string, table_name string"
#: The catalog's views and their columns (fixed values: PostgreSQL's names of the columns that clients read).
VIEWS = {
    "information_schema_tables": f"{_TABLE}, table_type string, is_insertable_into string",
    "information_schema_columns": f"{_TABLE}, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, udt_name string",
    "information_schema_table_constraints": f"{_CONSTRAINT}, {_TABLE}, constraint_type string",
    "information_schema_key_column_usage": f"{_CONSTRAINT}, {_TABLE}, column_name string, ordinal_position int",
    "information_schema_triggers": "trigger_catalog string, trigger_schema string, trigger_name string, event_manipulation string, event_object_catalog string, event_object_schema string, event_object_table string, action_order int, action_condition string, action_statement string, action_orientation string, action_timing string",
    "pg_class": "oid long, relname string, relnamespace long, reltype long, relowner long, relam long, reltuples float, relhasindex boolean, relpersistence string, relkind string, relnatts int, relispartition boolean",
    "pg_attribute": "attrelid long, attname string, atttypid long, attlen int, attnum int, atttypmod int, attnotnull boolean, atthasdef boolean, attidentity string, attgenerated string, attisdropped boolean, attcollation long, atttype string",
    "pg_type": "oid long, typname string, typnamespace long, typowner long, typlen int, typtype string, typcategory string, typrelid long, typelem long, typarray long, typbasetype long, typtypmod int",
    "pg_index": "indexrelid long, indrelid long, indnatts int, indisunique boolean, indisprimary boolean, indisvalid boolean, indkey array<int>, indexprs string, indpred string",
    "pg_constraint": "oid long, conname string, connamespace long, contype string, condeferrable boolean, condeferred boolean, conrelid long, conindid long, confrelid long, conkey array<int>, confkey array<int>",
    "pg_namespace": "oid long, nspname string, nspowner long, nspacl string",
    "pg_database": "oid long, datname string, datdba long, encoding int, datcollate string, datctype string, datistemplate boolean, datallowconn boolean",
    "pg_am": "oid long, amname string, amhandler string, amtype string",
    "pg_language": "oid long, lanname string, lanowner long, lanispl boolean, lanpltrusted boolean",
    "pg_proc": "oid long, proname string, pronamespace long, proowner long, prolang long, prokind string, prorettype long, proargtypes string, prosrc string",
    "pg_range": "rngtypid long, rngsubtype long, rngmultitypid long, rngcollation long, rngsubopc long, rngcanonical string, rngsubdiff string",
    "pg_extension": "oid long, extname string, extowner long, extnamespace long, extrelocatable boolean, extversion string, extconfig array<long>, extcondition array<string>",
    "pg_statio_user_tables": "relid long, schemaname string, relname string, heap_blks_read long, heap_blks_hit long, idx_blks_read long, idx_blks_hit long",
    "pg_description": "objoid long, classoid long, objsubid int, description string",
    "pg_shdescription": "objoid long, classoid long, description string",
    "pg_attrdef": "oid long, adrelid long, adnum int, adbin string",
    "pg_trigger": "oid long, tgrelid long, tgparentid long, tgname string, tgfoid long, tgtype int, tgenabled string, tgisinternal boolean, tgconstraint long",
    "pg_depend": "classid long, objid long, objsubid int, refclassid long, refobjid long, refobjsubid int, deptype string",
    "pg_inherits": "inhrelid long, inhparent long, inhseqno int, inhdetachpending boolean",
    "pg_available_extensions": "name string, default_version string, installed_version string, comment string",
    "pg_conversion": "oid long, conname string, connamespace long, conowner long, conforencoding int, contoencoding int, conproc string, condefault boolean",
    "pg_opclass": "oid long, opcmethod long, opcname string, opcnamespace long, opcowner long, opcfamily long, opcintype long, opcdefault boolean, opckeytype long",
    "pg_opfamily": "oid long, opfmethod long, opfname string, opfnamespace long, opfowner long",
}
#: PostgreSQL's type numbers and the names they are shown by (fixed values).
TYPE_OIDS = {
    16: "boolean", 17: "bytea", 18: '"char"', 19: "name", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 26: "oid", 114: "json", 700: "real", 701: "double precision",
    1043: "character varying", 1082: "date", 1083: "time without time zone", 1114: "timestamp without time zone", 1700: "numeric",
}


#: The numbers of the short names that columns are shown by (fixed values).
SHORT_OIDS = {"int8": 20, "float8": 701, "text": 25, "bytea": 17, "bool": 16, "date": 1082, "timestamp": 1114, "numeric": 1700}


def pg_type(kind: T.DataType) -> str:
    """The PostgreSQL name of a Spark type."""
    names = {T.LongType: "int8", T.IntegerType: "int8", T.ShortType: "int8", T.ByteType: "int8", T.DoubleType: "float8", T.FloatType: "float8", T.StringType: "text", T.BinaryType: "bytea", T.BooleanType: "bool", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp"}
    if isinstance(kind, T.ArrayType):
        return f"{pg_type(kind.elementType)}[]"
    return "numeric" if isinstance(kind, T.DecimalType) else names.get(type(kind), "text")
