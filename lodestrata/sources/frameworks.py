"""Bridge kinds of a repository by markers in its manifests and by its files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dependencies in manifests and the kinds of bridges that they stand for.
MARKERS = {
    "Cargo.toml": {
        "tauri": "tauri_command tauri_event", "napi": "napi", "napi-derive": "napi", "wasm-bindgen": "wasm_bindgen", "pyo3": "pyo3", "actix-web": "http_route", "axum": "http_route", "rocket": "http_route", "libloading": "ffi", "libffi": "ffi", "jni": "ffi jni", "bindgen": "ffi", "cbindgen": "ffi",
        "uniffi": "uniffi", "tonic": "grpc", "prost": "grpc", "grpcio": "grpc",
    },
    "package.json": {"@tauri-apps/api": "tauri_command tauri_event", "express": "http_route", "fastify": "http_route", "@napi-rs/cli": "napi", "ffi-napi": "ffi", "koffi": "ffi", "node-ffi": "ffi", "@grpc/grpc-js": "grpc", "@grpc/proto-loader": "grpc", '"electron"': "electron"},
    "pyproject.toml": {"pyo3": "pyo3", "maturin": "pyo3", "fastapi": "http_route", "flask": "http_route", "django": "http_route", "cffi": "ffi", "grpcio": "grpc", "grpcio-tools": "grpc"},
    "tauri.conf.json": {"": "tauri_command tauri_event"},
    "pubspec.yaml": {"flutter:": "flutter", "sdk: flutter": "flutter"},
}
C_ENDINGS = ["c", "cpp", "cc", "cxx", "h", "hpp", "hh", "hxx"]


def detect_bridges(files: DataFrame) -> DataFrame:
    """(root_id, kind) of files (root_id, path, content): by manifests; ffi where there are C sources, cgo where there is a Go module too, grpc where there are proto files."""
    name = F.substring_index("path", "/", -1)
    spark = files.sparkSession
    rows = [(m, marker, kind) for m, markers in MARKERS.items() for marker, kinds in markers.items() for kind in kinds.split()]
    table = spark.createDataFrame(rows, "name string, marker string, kind string")  # the fixed values
    manifests = files.select("root_id", name.alias("name"), F.coalesce("content", F.lit("")).alias("content")).where(F.col("name").isin(*MARKERS))
    by_manifest = manifests.join(F.broadcast(table), "name").where(F.col("content").contains(F.col("marker"))).select("root_id", "kind")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    signs = files.groupBy("root_id").agg(F.max(ending.isin(*C_ENDINGS)).alias("c"), F.max(name == "go.mod").alias("go"), F.max(ending == "proto").alias("proto"))
    found = [signs.where(w).select("root_id", F.lit(k).alias("kind")) for w, k in (("c", "ffi"), ("c and go", "cgo"), ("proto", "grpc"))]
    return functools.reduce(DataFrame.unionByName, found, by_manifest).distinct()
