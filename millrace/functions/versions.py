"""Dependencies that manifests name, and their versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each manifest names a dependency and its version.
MANIFESTS = {
    "go.mod": r"(?m)^\s*(?:require\s+)?([\w./~-]+\.[\w./~-]+)\s+v([\w.+-]+)",
    "requirements.txt": r"(?m)^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:==|>=|~=|<=|>|<)\s*([0-9][\w.*]*)",
    "package.json": r"\"(@?[\w./-]+)\"\s*:\s*\"[\^~>=<v ]*([0-9][\w.+-]*)\"",
    "Cargo.toml": r"(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?\"[\^~=]*([0-9][\w.+-]*)\"",
    "Gemfile.lock": r"(?m)^    ([\w.-]+) \(([0-9][\w.]*)\)",
    "pyproject.toml": r"\"([A-Za-z0-9._-]+)\s*(?:==|>=|~=)\s*([0-9][\w.*]*)",
    "pom.xml": r"<artifactId>([^<]+)</artifactId>\s*<version>v?([0-9][^<]*)</version>",
}


def dependencies(path: Column, text: Column) -> Column:
    """map of dependency to version of a manifest; null for other files."""
    name, out = F.element_at(F.split(path, "/"), -1), None
    for file, pattern in MANIFESTS.items():
        names, versions = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
        keys = F.array_distinct(names)
        found = F.map_from_arrays(keys, last_of(keys, names, versions))
        out = F.when(name == file, found) if out is None else out.when(name == file, found)
    return out


def last_of(keys: Column, names: Column, values: Column) -> Column:
    pairs = F.arrays_zip(F.transform(names, lambda n: F.struct(n.alias("x"))), F.transform(values, lambda v: F.struct(v.alias("x"))))
    return F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["0"]["x"] == k), -1)["1"]["x"])


def major_bumps(old: Column, new: Column) -> Column:
    """Dependencies of both manifests whose major version differs, and those only one has, sorted."""
    major = lambda v: F.substring_index(v, ".", 1)
    every = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.sort_array(F.filter(every, lambda k: ~(major(old[k]).eqNullSafe(major(new[k])))))
