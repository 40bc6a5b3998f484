"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added up as log probabilities per language: what the text looks like (a multinomial model of byte
trigrams, counted over the whole corpus by declared language), the language that the markup declares, the suffix of the
address, and a prior of the host. Host priors are smoothed along a hierarchy: a host leans on its domain, a domain on the
whole corpus, each by a fixed weight of imagined rows. They are grouped sums of what the other evidence says,
so a hot host is one row of partial sums per task. One more outcome, ``und``, explains text as even noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import cut, prepare, tidy, trim

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
GRAMS = 1 << 14
#: Chance that a declaration is right, and that a country's suffix names the language.
DECLARED, SUFFIXED = 0.9, 0.6
#: Country suffixes of each language.
SUFFIXES = {"de": ("de", "at", "ch"), "en": ("uk", "us", "au", "ie", "nz"), "es": ("es", "mx", "ar", "cl"), "fr": ("fr", "be")}
#: Rows that a domain's and a host's prior lean on, the chance of noise, and trigrams that count in full (neighbouring trigrams
#: repeat each other, so a longer text counts with the root of its excess).
LEAN_DOMAIN, LEAN_HOST, NOISE, FULL = 20.0, 10.0, 0.01, 50.0
THRESHOLD = 0.5
#: Share of even noise within each language: keys, names and numbers in a clean text don't make it noise.
EVEN = 0.1


def grams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the whole text, letters in lower case; digits don't tell languages apart and are dropped."""
    text = text.decode("utf-8", "replace").lower().encode().translate(None, b"0123456789")
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    return ((a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def gram_model(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """log P(trigram | language), a row per language and one of even noise, counted over all rows (text as binary, declared).

    Rows that declare none of the languages count nowhere. A row per task, language and trigram is added up; the
    table has ``len(languages) * GRAMS`` rows at most.
    """
    number = {c: i for i, c in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), GRAMS), np.int64)
        for b in batches:
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d in number and t:
                    seen[number[d]] += np.bincount(grams(t), minlength=GRAMS)
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen.ravel()[at], pa.int64())], ["cell", "n"])

    counts = np.full(len(languages) * GRAMS, 0.5)
    got = rows.select("text", "declared").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[got["cell"].to_numpy()] += got["n"].to_numpy()
    counts = counts.reshape(len(languages), GRAMS)
    table = np.log((1 - EVEN) * counts / counts.sum(axis=1, keepdims=True) + EVEN / GRAMS)
    return np.vstack((table, np.full(GRAMS, -np.log(GRAMS)))).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray, text: Column) -> Column:
    """array<double>: the damped log likelihood of a text for each language and for noise; zeros for texts under three bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))

    def run(v: pa.Array) -> pa.Array:
        table, out = shared.value, []
        for t in v.to_pylist():
            g = grams(t or b"")
            total, n = np.zeros(table.shape[1]), len(g)
            for a in range(0, n, 1 << 18):
                total += table[g[a:a + (1 << 18)]].sum(axis=0, dtype=np.float64)
            if n:
                total *= (n if n <= FULL else FULL + np.sqrt(n - FULL)) / n
            out.append(total)
        trim()
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)


def _said(value: Column, languages: tuple[str, ...], right: float, words: dict[str, tuple[str, ...]]) -> Column:
    """Log probabilities of a statement about the language; zeros where it says nothing known."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    known = F.coalesce(value.isin(*[w for c in languages for w in words[c]]), F.lit(False))
    each = [F.when(value.isin(*words[c]), F.log(F.lit(right))).otherwise(F.log(F.lit(wrong))) for c in languages]
    noise = F.log(F.lit(1 / max(1, len(languages))))
    return F.when(known, F.array(*each, noise)).otherwise(F.array(*[F.lit(0.0)] * (len(languages) + 1)))


def _sum(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def posterior(scores: Column) -> Column:
    """Log scores as probabilities that add up to 1."""
    top = F.array_max(scores)
    up = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(up, lambda s: s / F.aggregate(up, F.lit(0.0), lambda a, x: a + x))


def host_priors(seen: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """host, prior (array<double> of log probabilities) out of rows (host, domain, belief: array<double>), for every host."""
    n = len(languages)
    sums = [F.sum(F.col("belief")[i]).alias(f"s{i}") for i in range(n)]
    hosts = seen.groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    whole = domains.agg(*[(F.coalesce(F.sum(f"d{i}"), F.lit(0.0)) + 1).alias(f"g{i}") for i in range(n)])
    total = {p: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0")) for p in "sdg"}
    both = hosts.join(domains, "domain").join(F.broadcast(whole))  # one row
    world = [F.col(f"g{i}") / total["g"] for i in range(n)]
    domain = [(F.col(f"d{i}") + LEAN_DOMAIN * world[i]) / (total["d"] + LEAN_DOMAIN) for i in range(n)]
    host = [(F.col(f"s{i}") + LEAN_HOST * domain[i]) / (total["s"] + LEAN_HOST) for i in range(n)]
    return both.select("host", F.array(*[F.log((1 - NOISE) * p) for p in host], F.log(F.lit(NOISE))).alias("prior"))


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def declared_of(html: Column) -> Column:
    """Two-letter language that the html element of a page declares; empty where it declares none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))


def identify(rows: DataFrame, text: Column, declared: Column, host: Column, languages: tuple[str, ...] = LANGUAGES, threshold: float = THRESHOLD,
             into: str = "language_id") -> DataFrame:
    """All rows and columns of ``rows`` with ``into``: struct<language, probability, text_language, declared, kept>.

    language: the likeliest of ``languages`` and ``und``, ties to the earlier one. text_language: by the text alone, null without three bytes
    of it. kept: a language, not noise, is at least as likely as ``threshold``. Null or empty text, declaration or host say
    nothing: what is left decides, in the end the corpus. Repeated rows count as often as they are there. An
    empty table gives no rows. Very long texts count whole, in parts. A column that is named like ``into`` is replaced.
    """
    spark = prepare(rows.sparkSession)
    names = [c for c in rows.columns if c != into]
    inner = rows.select(*[rows[c].alias(f"_c{i}") for i, c in enumerate(names)], F.coalesce(text, F.lit("")).cast("binary").alias("text"),
                        F.lower(F.substring(F.coalesce(declared, F.lit("")), 1, 2)).alias("declared"), F.coalesce(host, F.lit("")).alias("host"))
    model = gram_model(inner, languages)
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(F.lit(""))
    said = _sum(_said(F.col("declared"), languages, DECLARED, {c: (c,) for c in languages}), _said(suffix, languages, SUFFIXED, {c: SUFFIXES.get(c, (c,)) for c in languages}))

    def evidence(df: DataFrame) -> DataFrame:
        return df.withColumn("looks", text_evidence(df, model, F.col("text"))).withColumn("score", _sum(F.col("looks"), said))

    seen = evidence(inner.select("text", "declared", "host")).select("host", domain_of(F.col("host")).alias("domain"), posterior(F.col("score")).alias("belief"))
    priors = cut(host_priors(seen, languages))  # a table of known size: broadcast if it is small, else texts don't travel twice
    fused = evidence(inner).withColumn("enough", F.octet_length("text") >= 3).drop("text").join(priors, "host", "left").withColumn("p", posterior(_sum(F.col("score"), F.col("prior"))))
    codes = F.array(*[F.lit(c) for c in (*languages, UNKNOWN)])

    def best(of: Column) -> Column:
        return F.get(codes, (F.array_position(of, F.array_max(of)) - 1).cast("int"))

    language, sure = best(F.col("p")), F.array_max("p")
    out = F.struct(language.alias("language"), sure.alias("probability"), F.when(F.col("enough"), best(F.col("looks"))).alias("text_language"),
                   F.nullif("declared", F.lit("")).alias("declared"), ((language != UNKNOWN) & (sure >= threshold)).alias("kept"))
    return fused.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], out.alias(into))


def identify_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", source_col: str = "source",
                       into: str = "language_id") -> DataFrame:
    """``identify`` for documents: ``lang`` is what they declare, ``source`` their host."""
    return identify(docs, docs[text_col], docs[declared_col], docs[source_col], into=into)


def identify_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` for web pages: the text is what stands between tags, scripts and styles left out."""
    text = F.regexp_replace(F.regexp_replace(pages[html_col], r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&#?\w+;", " ")
    return identify(pages, text, declared_of(pages[html_col]), host_of(pages[url_col]))
