"""Files as rows: scans with ignore rules, and the parser that a path calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders, folder patterns and file patterns that are never read.
IGNORED_FOLDERS = (
    ".git .svn .hg .jj .idea .vs .vscode .zed .fleet .cache .ccls-cache .clangd target out dist coverage vendor 3rdparty third_party third-party thirdparty node_modules bower_components build __pycache__"
    " .venv venv .tox .mypy_cache .pytest_cache .next .nuxt Pods site-packages"
).split()
IGNORED_FOLDER_PATTERNS = ["bazel-*", "cmake-build-*", "*.egg-info", "*.xcodeproj", "*.xcworkspace", "*.framework", "*.xcassets"]
IGNORED_FILE_PATTERNS = (
    "*.min.js *.min.css *.map *.chunk.js *.bundle.js *.lock package-lock.json Cargo.lock yarn.lock pnpm-lock.yaml tokenizer.json *.onnx *.bin *.safetensors *.snap *.generated.h *.gen.cpp *.pb.go *_pb2.py *_pb2.pyi"
    " *_pb2_grpc.py *.pb.cc *.pb.h *_pb.rb *_pb.dart *.g.dart *.g.cs *.Designer.cs *.generated.cs *.tsbuildinfo compile_commands.json CMakeCache.txt"
).split()
# What reads a file, by extension or name.
MARKDOWN = ["md", "markdown", "mkd", "mdx"]
HTML = ["html", "htm", "xhtml"]
CODE = "rs py js jsx mjs ts tsx go java c h cpp cc cxx hpp cs rb php swift kt kts scala lua sh bash zig hs ml ex exs dart r jl sql toml json yaml yml proto asm s hlsl glsl wgsl".split()
CODE_NAMES = "Dockerfile Containerfile Makefile GNUmakefile Justfile justfile Rakefile Gemfile Podfile Brewfile Vagrantfile Fastfile Appfile CMakeLists.txt".split()


def _glob(pattern: str) -> str:
    out = ""
    for c in pattern:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_-/" else c
    return out


def is_excluded(path: Column, extra: list[str] | None = None) -> Column:
    """Whether ignore rules leave a path out."""
    folders = "|".join([*map(_glob, IGNORED_FOLDERS), *map(_glob, IGNORED_FOLDER_PATTERNS)])
    names = "|".join(map(_glob, [*IGNORED_FILE_PATTERNS, *(extra or [])]))
    return path.rlike(rf"(^|/)({folders})/") | path.rlike(rf"(^|/)({names})$")


def parser_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return (
        F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*HTML), "html").when(ext == "pdf", "pdf")
        .when(ext.isin(*CODE) | name.isin(*CODE_NAMES) | name.rlike(r"^(Dockerfile|Containerfile)\."), "code")
    )


def scan(spark: SparkSession, paths: list[str] | str, glob: str | None = None, extra_ignores: list[str] | None = None) -> DataFrame:
    """(path, mtime, n_bytes, content, kind) of the files under folders, files or patterns; ignored ones are left out before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(paths)
    kept = raw.where(~is_excluded(F.col("path"), extra_ignores))
    return kept.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"), F.col("content").cast("string").alias("content"), parser_kind(F.col("path")).alias("kind"))
