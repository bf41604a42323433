"""Datasets on disk: a folder of Parquet with a description beside it. Building, appending, listing, renaming, sealing."""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.operators.dedup import deduplicate, report
from docquery.sources import ingest, readers
from docquery.sources.classify import column_map

ROUNDS = 600_000
PART = "_part"


class Catalog:
    """All datasets under one root, which any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def _read(self, name: str) -> dict:
        path = self._at(name, "meta.json")
        if not self._exists(path):
            return {}
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _write(self, name: str, meta: dict) -> None:
        out = self.fs.create(self._path(self._at(name, "meta.json")), True)
        try:
            out.write(bytearray(json.dumps(meta, indent=1), "utf-8"))
        finally:
            out.close()

    def _status(self, path: str) -> list[int]:
        p = self._path(path)
        s = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        return [s.getModificationTime(), s.getLen()]

    # datasets

    def names(self) -> list[str]:
        if not self._exists(self.root):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.root)) if self._exists(self._at(s.getPath().getName(), "meta.json")))

    def health(self) -> dict:
        return {"status": "green", "datasets": len(self.names())}

    def create(self, name: str, mapping: dict | None = None) -> None:
        if self._exists(self._at(name, "meta.json")):
            raise ValueError(f"{name} exists")
        self._write(name, {"manifest": {}, "column_map": {}, "mapping": mapping or {}})

    def rename(self, old: str, new: str) -> None:
        if self._exists(self._at(new)) or not self._exists(self._at(old)):
            raise ValueError(f"{old} can't become {new}")
        self.fs.rename(self._path(self._at(old)), self._path(self._at(new)))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(self._at(name)), True)

    def mapping(self, name: str) -> dict:
        meta = self._read(name)
        return {k: v["semantic_type"] for k, v in meta.get("column_map", {}).items()} | meta.get("mapping", {})

    def put_mapping(self, name: str, mapping: dict) -> None:
        meta = self._read(name)
        self._write(name, meta | {"mapping": meta.get("mapping", {}) | mapping})

    def stats(self, name: str) -> dict:
        df, meta = self.open(name), self._read(name)
        size = self.fs.getContentSummary(self._path(self._at(name))).getLength()
        return {"total_docs": df.count(), "bytes": size, "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "sources": sorted(meta.get("manifest", {}))}

    # building

    def _open_to_writing(self, name: str) -> dict:
        """The dataset's description, made if it isn't there; sealed datasets take no rows."""
        if not self._exists(self._at(name, "meta.json")):
            self.create(name)
        meta = self._read(name)
        if "sealed" in meta:
            raise PermissionError(f"{name} is sealed; unseal it before rows are added or replaced")
        return meta

    def build(self, name: str, path: str, delimiter: str | None = None, columns: list[str] | None = None, overrides: dict | None = None, dedup: bool = False, fields: list[str] | None = None) -> dict:
        """Take in a file, or every data file of a folder. Files that haven't changed are skipped; those that have replace their rows.

        A file is known by its path, so files of one name in several folders are several files. Names given to a file without
        a header, and its delimiter, are kept for when it has changed.
        """
        files = readers.discover(self.spark, path) if readers.is_folder(self.spark, path) else [path]
        self._open_to_writing(name)
        done = {"indexed": [], "skipped": []}
        for f in files:
            meta, status = self._read(name), self._status(f)
            if meta.get("manifest", {}).get(f) == status:
                done["skipped"].append(f)
                continue
            how = {"delimiter": delimiter, "columns": columns}
            how = {k: v if v is not None else meta.get("headers", {}).get(f, {}).get(k) for k, v in how.items()}
            raw = readers.read(self.spark, f, how["delimiter"], how["columns"])
            kinds = column_map(raw, meta.get("mapping", {}) | (overrides or {}))
            rows = ingest.prepare(raw, {k: v["semantic_type"] for k, v in kinds.items()}, name, os.path.basename(f), self._next(name))
            if dedup:
                rows = deduplicate(rows, fields)
            meta = self._store(name, meta, rows, f)
            meta["manifest"] = meta.get("manifest", {}) | {f: status}
            if any(how.values()):
                meta["headers"] = meta.get("headers", {}) | {f: how}
            meta["column_map"] = meta.get("column_map", {}) | {v["canonical_key"]: v for v in kinds.values()}
            self._write(name, meta)
            done["indexed"].append(f)
        return done

    def estimate(self, path: str, rows: int = 5000) -> dict:
        """Rows, bytes and seconds that building a file would take, from its first ``rows`` rows."""
        raw = readers.read(self.spark, path).limit(rows)
        size = self._status(path)[1]
        sampled = raw.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns)))))).first()
        began = time.time()
        kinds = column_map(raw)
        ingest.prepare(raw, {k: v["semantic_type"] for k, v in kinds.items()}, "estimate", "estimate").write.format("noop").mode("overwrite").save()
        took = time.time() - began
        total = sampled[0] if sampled[0] < rows else round(size / max(1.0, (sampled[1] or 1) / sampled[0]))
        return {"bytes": size, "rows": total, "seconds": round(took * max(1.0, total / max(1, sampled[0])), 3)}

    def append(self, name: str, rows: DataFrame | list[dict], source: str | None = None) -> int:
        """Add documents; ids go on from the largest so far. The rows are written out once first, so that they are numbered as they are stored."""
        meta = self._open_to_writing(name)
        if not isinstance(rows, DataFrame):
            lines = self.spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
            rows = lines.select(F.from_json("value", readers.json_schema(lines)).alias("d")).select("d.*")
        staged = self._at(name, f"data.in-{secrets.token_hex(8)}")
        rows.write.parquet(staged)
        try:
            df = self.spark.read.schema(rows.schema).parquet(staged)
            kinds = column_map(df, meta.get("mapping"))
            source = source or f"bulk-{secrets.token_hex(8)}"
            out = ingest.prepare(df, {k: v["semantic_type"] for k, v in kinds.items()}, name, source, self._next(name))
            meta = self._store(name, meta, out, f"append:{source}")
            meta["column_map"] = meta.get("column_map", {}) | {v["canonical_key"]: v for v in kinds.values()}
            self._write(name, meta)
            return df.count()
        finally:
            self.fs.delete(self._path(staged), True)

    def _next(self, name: str) -> int:
        if not self._exists(self._at(name, "data")):
            return 0
        last = self.spark.read.schema("_id bigint").parquet(self._at(name, "data")).agg(F.max("_id")).first()[0]
        return 0 if last is None else last + 1

    def _store(self, name: str, meta: dict, rows: DataFrame, file: str) -> dict:
        """One partition for each file or batch, so that its new rows replace its old ones and nothing else.

        A column has one type in the whole dataset, kept in its description. Where new rows need a wider one, the rows that
        are there are written anew.
        """
        known = self._schema(meta)
        rows = rows.select([F.col(f"`{c}`").cast("string").alias(c) if k == "void" else F.col(f"`{c}`") for c, k in rows.dtypes])
        schema = ingest.merged_schema(known, rows.schema) if known else rows.schema
        if known and self._exists(self._at(name, "data")) and ingest.needs_rewriting(known, schema):
            self._replace(name, ingest.as_schema(self._raw(name, known), T.StructType([*schema.fields, T.StructField(PART, T.StringType())])))
            meta = meta | {"schema": schema.json()}
            self._write(name, meta)
        part = hashlib.sha256(file.encode()).hexdigest()[:20]
        out = ingest.as_schema(rows, schema).withColumn(PART, F.lit(part))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self._at(name, "data"))
        return meta | {"schema": schema.json()}

    @staticmethod
    def _schema(meta: dict) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(meta["schema"])) if "schema" in meta else None

    def _raw(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows with the file or batch they are of. The schema is known, so no file's footer is read to find it out."""
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.StringType())])).parquet(self._at(name, "data"))

    def open(self, name: str, passphrase: str | None = None) -> DataFrame:
        meta = self._read(name)
        if not meta:
            raise ValueError(f"there is no dataset {name}")
        if "sealed" in meta:
            return self._unsealed(name, meta["sealed"], passphrase).drop(PART)
        schema = self._schema(meta)
        if schema is None:
            return self.spark.createDataFrame([], "_id bigint, _dataset string, _source string")
        return self._raw(name, schema).drop(PART)

    @classmethod
    def load(cls, spark: SparkSession, path: str, passphrase: str | None = None) -> DataFrame | dict[str, DataFrame]:
        """The dataset at a path, or all those in it by name."""
        root, _, name = path.rstrip("/").rpartition("/")
        own = cls(spark, path)
        if own._exists(own._at("meta.json")):
            return cls(spark, root).open(name, passphrase)
        return {n: own.open(n, passphrase) for n in own.names()}

    def deduplicate(self, name: str, fields: list[str] | None = None, dry_run: bool = False) -> dict:
        """Remove later duplicates; with ``dry_run`` only count them."""
        meta = self._open_to_writing(name)
        df = self._raw(name, self._schema(meta))
        counts = report(df, fields).first().asDict()
        if not dry_run and counts["duplicates"]:
            self._replace(name, deduplicate(df, fields))
        return counts

    def _replace(self, name: str, rows: DataFrame, **options: str) -> None:
        """Write all rows anew, then put them in the place of the old ones."""
        new, old = self._at(name, "data.new"), self._at(name, "data")
        rows.write.mode("overwrite").options(**options).partitionBy(PART).parquet(new)
        self.fs.delete(self._path(old), True)
        self.fs.rename(self._path(new), self._path(old))

    # sealing

    @staticmethod
    def _key(passphrase: str, salt: str) -> str:
        return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), bytes.fromhex(salt), ROUNDS).hex()

    def _keys(self, key: str) -> DataFrame:
        """The key as a table of one row: a literal would stand in the plan, which interfaces and logs show."""
        return F.broadcast(self.spark.createDataFrame([(bytearray.fromhex(key),)], "_key binary"))

    def seal(self, name: str, passphrase: str) -> None:
        """Replace the rows by their ids and one encrypted value each (AES in GCM mode, the key from the passphrase)."""
        meta = self._open_to_writing(name)
        schema = self._schema(meta)
        salt = secrets.token_hex(16)
        key = self._key(passphrase, salt)
        df = self._raw(name, schema).crossJoin(self._keys(key))  # one row
        body = F.aes_encrypt(F.to_json(F.struct(*(F.col(f"`{f}`") for f in schema.names if f != "_id"))).cast("binary"), F.col("_key"))
        self._replace(name, df.select("_id", body.alias("sealed"), PART))
        check = hashlib.sha256(bytes.fromhex(key)).hexdigest()
        self._write(name, meta | {"sealed": {"salt": salt, "check": check, "schema": T.StructType([f for f in schema.fields if f.name != "_id"]).json()}})

    def _unsealed(self, name: str, sealed: dict, passphrase: str | None) -> DataFrame:
        if passphrase is None or not self.authenticate(name, passphrase):
            raise PermissionError(f"{name} is sealed, and this isn't its passphrase")
        schema = T.StructType.fromJson(json.loads(sealed["schema"]))
        stored = self.spark.read.schema(f"_id bigint, sealed binary, {PART} string").parquet(self._at(name, "data"))
        plain = F.from_json(F.aes_decrypt("sealed", F.col("_key")).cast("string"), schema)
        return stored.crossJoin(self._keys(self._key(passphrase, sealed["salt"]))).select("_id", plain.alias("d"), PART).select("d.*", "_id", PART)

    def authenticate(self, name: str, passphrase: str) -> bool:
        sealed = self._read(name).get("sealed")
        return bool(sealed) and secrets.compare_digest(sealed["check"], hashlib.sha256(bytes.fromhex(self._key(passphrase, sealed["salt"]))).hexdigest())

    def unseal(self, name: str, passphrase: str) -> None:
        meta = self._read(name)
        if "sealed" not in meta:
            raise ValueError(f"{name} isn't sealed")
        schema = self._schema(meta)
        self._replace(name, self._unsealed(name, meta["sealed"], passphrase).select(*(F.col(f"`{c}`") for c in schema.names), PART))
        meta.pop("sealed")
        self._write(name, meta)

    def compress(self, name: str, codec: str = "zstd") -> None:
        """Write the data anew with another codec."""
        meta = self._read(name)
        rows = self.spark.read.schema(f"_id bigint, sealed binary, {PART} string").parquet(self._at(name, "data")) if "sealed" in meta else self._raw(name, self._schema(meta))
        self._replace(name, rows, compression=codec)
