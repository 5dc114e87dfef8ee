"""Personal data by boosted candidates, in DataFrame expressions only.

Strict patterns give the base spans. Looser, high-recall generators propose further spans that may overlap; each
becomes a row of format and context features, gradient-boosted trees score it, and it is selected above its kind's
calibrated threshold. Everything is one projection over the documents, without a shuffle. The trees are fitted on
the driver from labelled examples that `examples()` makes by rule (at most EXAMPLES of them), so a verdict depends
on the text alone and not on the corpus it came with; their features come from the same expressions.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The bound on labelled examples.
EXAMPLES = 4000

#: The base patterns, written without useless retries (possessive, anchored at the start of a run).
#: Only possessive groups repeat without bound: Java runs any other such group by recursion, as deep as the text is long.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The looser generators.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}[\x20./-][0-9]{3,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z])",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {
    "base_email": "@",
    "base_ip": r"[0-9]\.[0-9]",
    "base_card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "base_phone": r"\+[0-9]",
    "loose_email": r"@\x20|\x20@|[\[({\x20]at[\])}\x20].{0,80}(?:dot|\.)",
    "loose_ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]",
    "loose_card": r"[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]",
    "loose_phone": r"[0-9]\)?[\x20./-]\x20?[0-9]{2,4}[\x20./-][0-9]{3}",
}
SPANS = "array<struct<s:int,e:int,t:string>>"
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, int(substring({d}, -i, 1)),"
    " if(int(substring({d}, -i, 1)) > 4, int(substring({d}, -i, 1)) * 2 - 9, int(substring({d}, -i, 1)) * 2))) % 10 = 0"
)
DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": r"forall(split(x.t, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": f"length({DIGITS}) between 13 and 19 and {LUHN.format(d=DIGITS)}",
    "phone": f"length({DIGITS}) between 9 and 15",
}
#: Binary features of a candidate c: k its kind, t its text, l and r the text before and after it.
OWN_DIGITS = "regexp_replace(c.t, '[^0-9]', '')"
FEATURES = {
    "digits_9_up": f"length({OWN_DIGITS}) >= 9",
    "digits_13_up": f"length({OWN_DIGITS}) >= 13",
    "digits_over_15": f"length({OWN_DIGITS}) > 15",
    "luhn": f"length({OWN_DIGITS}) between 13 and 19 and {LUHN.format(d=OWN_DIGITS)}",
    "one_separator": r"length(c.t) - length(regexp_replace(c.t, '[\\x20._/-]', '')) <= 3",
    "bracket": r"c.t rlike '[\\[({]'",
    "at_sign": "c.t like '%@%'",
    "known_end": r"lower(c.t) rlike '[^a-z0-9:](com|org|net|edu|gov|info|io|de|fr|es|uk)$'",
    "marked_dot": r"lower(c.t) rlike '[\\[({]dot[\\])}]'",
    "colons_7": "length(c.t) - length(replace(c.t, ':', '')) >= 7 or c.t like '%::%'",
    "hex_letter": "c.t rlike '[a-fA-F]'",
    "date_like": r"c.t rlike '^(19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}$|^[0-9]{2}[./-][0-9]{2}[./-](19|20)[0-9]{2}$'",
    "three_three_four": r"c.t rlike '^[(]?[0-9]{3}[)]?[\\x20.-]?\\x20?[0-9]{3}[.\\x20-][0-9]{4}$'",
    "after_word": "c.l rlike '[A-Za-z0-9_]$'",
    "after_quote": "c.l rlike '[\"=#:/\\\\\\\\]$'",
    "before_word": "c.r rlike '^[A-Za-z0-9_]'",
    "more_numbers": r"c.r rlike '^[\\x20./-][0-9]' or c.l rlike '[0-9][\\x20./-]$'",
    "cue": r"lower(c.l) rlike '(mail|tel|phone|call|fax|mobile|contact|reach|write|card|visa|credit|host|server|address)[^.\\n]{0,20}$'",
    "other_cue": r"lower(c.l) rlike '(isbn|token|key|order|version|invoice|date|time|serial|part|page|id)[^.\\n]{0,12}$'",
}


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add `name`: the pattern's matches with code-point positions (end exclusive), from left to right."""
    hits, gaps = f"{name}_hits", f"{name}_gaps"
    found = F.when(F.col("text").rlike(NEEDS[name]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    df = df.withColumn(hits, found)
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)))
    walk = (
        f"case when size({hits}) = 0 then cast(array() as {SPANS}) else aggregate(sequence(0, size({hits}) - 1),"
        f" named_struct('at', 0, 'got', cast(array() as {SPANS})),"
        f" (a, i) -> named_struct('at', a.at + length({gaps}[i]) + length({hits}[i]), 'got', concat(a.got,"
        f" array(named_struct('s', a.at + length({gaps}[i]), 'e', a.at + length({gaps}[i]) + length({hits}[i]), 't', {hits}[i])))),"
        " a -> a.got) end"
    )
    return df.withColumn(name, F.expr(walk)).drop(hits, gaps)


def _around(kind: str, array: str) -> str:
    """SQL: candidates with 32 code points on either side."""
    return (
        f"transform({array}, x -> named_struct('k', '{kind}', 's', x.s, 'e', x.e, 't', x.t,"
        " 'l', substring(text, greatest(x.s - 31, 1), least(x.s, 32)), 'r', substring(text, x.e + 1, 32)))"
    )


def _feature_sql() -> dict[str, str]:
    return FEATURES | {f"is_{k}": f"c.k = '{k}'" for k in KINDS}


# --- the model ----------------------------------------------------------------------------------


def examples(n: int = EXAMPLES) -> list[dict]:
    """Labelled candidates in context, made by rule from a fixed seed: half of them personal data, half look-alikes."""
    rng = random.Random(20)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def luhn(good: bool) -> str:
        body = digits(15)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(body))
        last = -total % 10
        return body + str(last if good else (last + rng.randint(1, 9)) % 10)

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    filler = lambda: " ".join(word() for _ in range(4))
    out = []
    while len(out) < n:
        good = len(out) % 2 == 0
        kind = KINDS[len(out) // 2 % 4]
        before, after = filler() + " ", " " + filler()
        if kind == "email":
            if good:
                left, right = rng.choice([("[", "]"), ("(", ")"), ("{", "}"), (" ", " ")])
                text = f"{word()}{rng.choice(['', '.', '_'])}{word()}{left}at{right}{word()}{left}dot{right}{rng.choice(['com', 'org', 'net', 'de'])}"
                if left == " ":
                    before += rng.choice(["mail me: ", "contact ", "write to "])
            else:
                text = rng.choice([f"{word()} at {word()} dot {word()}", f"{word()} at {word()}. {word().title()}", f"{word()} @ {word()} . {word()}", f"{word()} at {word()}.{word()}"])
        elif kind == "ip":
            group = lambda: format(rng.getrandbits(16), "x")
            if good:
                text = rng.choice([":".join(group() for _ in range(8)), f"2001:db8:{group()}::{group()}", f"fe80:{group()}::{group()}"])
            else:
                text = rng.choice([f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}", ":".join(format(rng.getrandbits(8), "02x") for _ in range(6))])
        elif kind == "card":
            number, sep = luhn(good), rng.choice([".", "/", "_", "  ", " - "])
            text = sep.join(number[i : i + 4] for i in range(0, 16, 4))
            if good and rng.random() < 0.5:
                before += rng.choice(["card ", "visa no. ", "credit card: "])
            if not good and rng.random() < 0.5:
                before += rng.choice(["serial ", "order "])
        elif good:
            text = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
            before += rng.choice(["call ", "tel. ", "phone: ", "fax ", ""])
        else:
            text = rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{digits(2)} {digits(3)} {digits(3)} {digits(2)}", f"{digits(3)}-{digits(3)}-{digits(3)}", f"{digits(4)} {digits(4)} {digits(4)}"])
            before += rng.choice(["", "order ", "version ", "isbn ", "page "])
            if rng.random() < 0.3:
                after = f" {digits(3)}" + after
        out.append({"k": kind, "t": text, "l": before[-32:], "r": after[:32], "y": int(good)})
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> tuple[float, list]:
    """Gradient boosting of depth-two trees on binary features (logistic loss, Newton leaves)."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, trees = np.full(len(y), base), []

    def leaf(g, h):
        return float(rate * g.sum() / (h.sum() + 1.0))

    def gain(g, h):
        return g.sum() ** 2 / (h.sum() + 1.0)

    def split(rows, g, h):
        best = (1e-9, None)
        for f in range(x.shape[1]):
            on = rows & x[:, f]
            off = rows & ~x[:, f]
            if on.any() and off.any():
                got = gain(g[on], h[on]) + gain(g[off], h[off]) - gain(g[rows], h[rows])
                best = max(best, (got, f), key=lambda b: b[0])
        return best[1]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        everything = np.ones(len(y), dtype=bool)
        root = split(everything, g, h)
        if root is None:
            break
        tree = [root]
        for side in (x[:, root], ~x[:, root]):
            f = split(side, g, h)
            if f is None:
                v = leaf(g[side], h[side])
                tree.append((0, v, v))
                score[side] += v
            else:
                on, off = side & x[:, f], side & ~x[:, f]
                tree.append((f, leaf(g[on], h[on]), leaf(g[off], h[off])))
                score[on] += tree[-1][1]
                score[off] += tree[-1][2]
        trees.append(tree)
    return base, trees


def tree_scores(x: np.ndarray, base: float, trees: list) -> np.ndarray:
    score = np.full(len(x), base)
    for root, on, off in trees:
        for side, (f, a, b) in ((x[:, root], on), (~x[:, root], off)):
            score += np.where(side, np.where(x[:, f], a, b), 0.0)
    return score


_MODEL: dict | None = None


def fitted(spark: SparkSession, precision: float = 0.98) -> dict:
    """The trees and each kind's threshold: a little below the cut that finds most held-out examples at the precision."""
    global _MODEL
    if _MODEL is None:
        rows = spark.range(1).select(
            F.explode(F.from_json(F.lit(json.dumps(examples())), "array<struct<k:string,t:string,l:string,r:string,y:int>>")).alias("c")
        )
        features = _feature_sql()
        got = rows.select("c.k", "c.y", *(F.expr(v).alias(k) for k, v in features.items())).collect()
        x = np.array([[r[f] for f in features] for r in got], dtype=bool)
        y = np.array([r["y"] for r in got], dtype=float)
        kinds = np.array([r["k"] for r in got])
        held = np.arange(len(y)) // 8 % 2 == 1
        base, trees = boost(x[~held], y[~held])
        score = tree_scores(x, base, trees)
        threshold = {}
        for k in KINDS:
            own = held & (kinds == k)
            order = np.argsort(-score[own], kind="stable")
            s, found = score[own][order], np.cumsum(y[own][order])
            last = np.concatenate((s[1:] != s[:-1], [True]))
            ok = np.flatnonzero(last & (found / np.arange(1, own.sum() + 1) >= precision))
            if not ok.size:
                threshold[k] = math.inf
                continue
            at = ok[found[ok].argmax()]  # the highest cut among those that find most
            below = s[at + 1] if at + 1 < s.size else s[at] - 1.0
            threshold[k] = float(0.75 * s[at] + 0.25 * below)
        _MODEL = {"features": list(features), "base": base, "trees": trees, "threshold": threshold,
                  "accuracy": float(((score[held] > 0) == (y[held] > 0)).mean())}
    return _MODEL


def _score_sql(model: dict) -> str:
    """SQL: the trees' sum over a candidate c whose features are c.f."""
    parts = [repr(model["base"])]
    for root, on, off in model["trees"]:
        inner = [f"if(c.f[{f}], {a!r}D, {b!r}D)" for f, a, b in (on, off)]
        parts.append(f"if(c.f[{root}], {inner[0]}, {inner[1]})")
    return " + ".join(parts)


def _chosen(kind: str, array: str, model: dict) -> str:
    """SQL: the candidates of an array of spans that score above their kind's threshold; features are made once each."""
    sql = _feature_sql()
    features = ", ".join(sql[name] for name in model["features"])
    featured = f"transform({_around(kind, array)}, c -> named_struct('s', c.s, 'e', c.e, 't', c.t, 'f', array({features})))"
    chosen = f"filter({featured}, c -> {_score_sql(model)} >= {model['threshold'][kind]!r}D)"
    return f"transform({chosen}, c -> named_struct('s', c.s, 'e', c.e, 't', c.t))"


# --- the operator -------------------------------------------------------------------------------


def _digest(kinds_spans: dict[str, str]) -> str:
    return "concat(" + ", ".join(f"transform({a}, x -> concat('{k}:', x.s, ':', x.e))" for k, a in kinds_spans.items()) + ")"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base_<kind>, all_<kind>): arrays of {s, e, t} in code points, end exclusive, by start.

    Null counts as empty; empty texts have empty arrays; null ids and repeated rows give results of their own; an empty
    table gives an empty one; other columns of docs are ignored. base_<kind> are the strict patterns' valid matches; all_<kind>
    adds selected candidates that overlap none of them.
    """
    model = fitted(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for k in KINDS:
        df = _located(df, f"base_{k}", BASE[k])
        df = _located(df, f"loose_{k}", LOOSE[k])
    df = df.withColumns({f"base_{k}": F.expr(f"filter(base_{k}, x -> {VALID[k]})") for k in KINDS})
    taken = "concat(" + ", ".join(f"base_{k}" for k in KINDS) + ")"
    df = df.withColumn("taken", F.expr(taken))
    for k in KINDS:
        if math.isinf(model["threshold"][k]):
            df = df.withColumn(f"more_{k}", F.expr(f"cast(array() as {SPANS})"))
            continue
        free = f"filter(loose_{k}, x -> not exists(taken, b -> b.s < x.e and x.s < b.e))"
        more = f"case when size(loose_{k}) = 0 then cast(array() as {SPANS}) else {_chosen(k, free, model)} end"
        df = df.withColumn(f"more_{k}", F.expr(more))
    out = df.withColumns({f"all_{k}": F.expr(f"array_sort(concat(base_{k}, more_{k}))") for k in KINDS})
    return out.select(F.col("id").alias(id_col), "text", *(f"base_{k}" for k in KINDS), *(f"all_{k}" for k in KINDS))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of find_pii; n_pii counts all spans, those that the method adds included."""
    found = find_pii(docs, id_col, text_col)
    every = sum((F.size(f"all_{k}") for k in KINDS[1:]), F.size(f"all_{KINDS[0]}"))
    base = F.array_join(F.expr(_digest({k: f"base_{k}" for k in KINDS})), ",")
    return found.select(
        id_col,
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.expr(_digest({k: f"all_{k}" for k in KINDS})), ",").alias("spans"),
        every.cast("long").alias("n_pii"),
    )


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every selected span replaced by its kind in angle brackets; overlapping spans become one.

    Columns as in docs; a null text stays null. Only the text column changes.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").isNull().alias("__null")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_pii(packed, "row", "text")
    tagged = "array_sort(concat(" + ", ".join(f"transform(all_{k}, x -> named_struct('s', x.s, 'e', x.e, 't', '<{k.upper()}>'))" for k in KINDS) + "))"
    found = found.withColumn("spans", F.expr(tagged))
    walk = (
        "case when row.`__null` then null when size(spans) = 0 then text else aggregate(spans, named_struct('at', 0, 'out', ''),"
        " (a, x) -> named_struct('at', greatest(a.at, x.e), 'out', case when x.s < a.at then a.out"
        " else concat(a.out, substring(text, a.at + 1, x.s - a.at), x.t) end),"
        " a -> concat(a.out, substring(text, a.at + 1, length(text)))) end"
    )
    clean = found.select("row", F.expr(walk).alias("clean"))
    return clean.select(*(F.col("clean").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
