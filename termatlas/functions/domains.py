"""Registered domains (public suffix plus one label) by broadcast lookups in the public suffix list."""

from __future__ import annotations

import glob
import json
import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = r"^(?:[a-zA-Z0-9+.-]*:?//)?(?:[^/?#@]*@)?([^/?#:]+)"
DEPTH = 4
#: Where Java HTTP clients carry the public suffix list on their class path.
RESOURCE = "mozilla/public-suffix-list.txt"
#: Setting that names a list of one's own, a path that Spark reads.
SETTING = "spark.termatlas.publicSuffixList"


def _from_class_path(spark: SparkSession) -> list[str]:
    """The copies on the driver JVM's class path, wherever its jars lie."""
    found = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResources(RESOURCE)
    out = []
    while found.hasMoreElements():
        stream = found.nextElement().openStream()
        out.append(bytes(stream.readAllBytes()).decode("utf-8"))
        stream.close()
    return out


def _from_jars() -> list[str]:
    """The copies in the jars of SPARK_HOME and of the pyspark package."""
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    out = []
    for jar in sorted(j for home in homes if home for j in glob.glob(os.path.join(home, "jars", "h*client*.jar"))):
        with zipfile.ZipFile(jar) as z:
            if RESOURCE in z.namelist():
                out.append(z.read(RESOURCE).decode("utf-8"))
    return out


def suffix_list(spark: SparkSession) -> str:
    """The text of the public suffix list: the session's own, or the fullest copy that Spark's HTTP clients carry."""
    if path := spark.conf.get(SETTING, None):
        return spark.read.text(path, wholetext=True).first()["value"]
    if not (copies := _from_class_path(spark) or _from_jars()):
        raise FileNotFoundError(f"{RESOURCE} is neither on the class path nor in Spark's jars; set {SETTING} to a copy of it")
    return max(copies, key=lambda x: (len(x), x))


@lru_cache(maxsize=4)
def suffix_rules(text: str) -> tuple[tuple[str, str], ...]:
    """(suffix, kind) rules of the list's ICANN section, a few thousand; kind is normal, wildcard or exception."""
    out = []
    for line in text.splitlines():
        if "===END ICANN DOMAINS===" in line:
            break
        rule = line.strip()
        if not rule or rule.startswith("//"):
            continue
        for written in {rule, rule.encode("idna").decode() if not rule.isascii() and "*" not in rule else rule}:
            if written.startswith("*."):
                out.append((written[2:], "wildcard"))
            elif written.startswith("!"):
                out.append((written[1:], "exception"))
            else:
                out.append((written, "normal"))
    return tuple(sorted(set(out)))


def rules_frame(spark: SparkSession) -> DataFrame:
    """(tld, normal, wildcard, exception): the suffixes of each kind under a last label."""
    groups: dict[str, dict[str, list[str]]] = {}
    for suffix, kind in suffix_rules(suffix_list(spark)):
        groups.setdefault(suffix.rpartition(".")[2], {"normal": [], "wildcard": [], "exception": []})[kind].append(suffix)
    rows = json.dumps([{"tld": tld, **kinds} for tld, kinds in groups.items()])
    shape = "array<struct<tld:string,normal:array<string>,wildcard:array<string>,exception:array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), shape)))


def host(url: Column) -> Column:
    """The host of a URL with or without scheme, user and port; '' if there is none."""
    return F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), F.lit("."))


def with_registered_domain(df: DataFrame, url: str = "url", name: str = "registered_domain") -> DataFrame:
    """Add the registered domain of df[url]: '' for null, for addresses, and for hosts without a known suffix.

    The last label is looked up in the broadcast rules (a fixed list of a few thousand suffixes), so the rows stay
    where they are; the longer endings are sought among the rules under it.
    """
    rules = F.broadcast(rules_frame(df.sparkSession).select(F.col("tld").alias("__tld"), *(F.col(c).alias(f"__{c}") for c in ("normal", "wildcard", "exception"))))
    out = df.withColumn("__labels", F.split(host(F.col(url)), r"\."))
    out = out.withColumn("__last", F.lower(F.element_at("__labels", -1))).join(rules, F.col("__last") == F.col("__tld"), "left")
    # one lambda over the endings of 1 to DEPTH labels: written out, the branches overflow a method of generated code
    suffix = F.expr(
        "case when __tld is null then 0 else aggregate("
        f"transform(sequence(1, least(size(__labels), {DEPTH})), k -> named_struct('k', k, 't', lower(array_join(slice(__labels, -k, k), '.')))),"
        " named_struct('len', 0, 'exc', 0), (a, x) -> named_struct("
        "'len', greatest(a.len, if(array_contains(__normal, x.t), x.k, 0), if(array_contains(__wildcard, x.t) and size(__labels) > x.k, x.k + 1, 0)),"
        " 'exc', greatest(a.exc, if(array_contains(__exception, x.t), x.k, 0))),"
        " a -> if(a.exc > 0, a.exc - 1, a.len)) end"
    )
    out = out.withColumn("__suffix", suffix)
    domain = F.expr("case when __suffix > 0 and size(__labels) > __suffix then array_join(slice(__labels, -(__suffix + 1), __suffix + 1), '.') else '' end")
    domain = F.when(domain.rlike(r"^\.|\.\."), "").otherwise(domain)
    return out.withColumn(name, domain).select(*(f"`{c}`" for c in df.columns if c != name), name)
