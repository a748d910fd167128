"""Column-to-column functions: coercion, keys, text, rules of classification."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens read as missing, by kind of source.
MISSING = {"call_file": ["", "NA", "."], "table": ["NA"], "strict": ["", "NA"], "inferred": ["", "#N/A", "#NA", "N/A", "NA", "NULL", "NaN", "None", "nan", "null", "n/a", "<NA>", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]}
#: Words read as true, by strictness.
TRUE_WORDS = {"wide": ["true", "t", "1", "yes", "y"], "narrow": ["true", "1", "yes", "y"]}


def missing_to_null(c: Column, source: str = "strict") -> Column:
    return F.when(~c.isin(MISSING[source]), c)


def number(c: Column) -> Column:
    """Double, null where the text is no finite number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def boolean(c: Column, words: str = "wide") -> Column:
    """True for the listed words, else false; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUE_WORDS[words]), F.lit(False))


def sample_key(c: Column, parts: int = 4, upper: bool = True, length: int | None = None) -> Column:
    """The first ``parts`` dash-separated parts; optionally upper-cased or cut to a length."""
    text = F.trim(c)
    text = F.upper(text) if upper else text
    text = F.array_join(F.slice(F.split(text, "-"), 1, parts), "-") if parts else text
    return F.substring(text, 1, length) if length else text


def group_key(c: Column, parts: int = 3) -> Column:
    return sample_key(c, parts)


def sample_code(c: Column) -> Column:
    """The two-digit code in the fourth part; null if there is none."""
    return F.substring(F.get(F.split(c, "-"), F.lit(3)), 1, 2).try_cast("int")


def is_primary_sample(c: Column) -> Column:
    """Codes 1 to 9."""
    return F.coalesce(sample_code(c).between(1, 9), F.lit(False))


#: Names of missing and of mitochondrial chromosomes.
NO_CHROMOSOME, MITOCHONDRIAL = ["", "nan", "none", "na"], ["25", "M", "MT", "MITO", "MITOCHONDRIA"]


def chromosome(c: Column) -> Column:
    """'chr' stripped, 23/24/25 as X/Y/MT, decimals as integers, missing as 'NA'."""
    text = F.upper(F.trim(F.replace(F.replace(F.trim(c.cast("string")), F.lit("chr"), F.lit("")), F.lit("CHR"), F.lit(""))))
    whole = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$"), text.try_cast("double").cast("bigint").cast("string"))
    missing = c.isNull() | F.lower(F.trim(c.cast("string"))).isin(NO_CHROMOSOME)
    return F.when(missing, "NA").when(text == "23", "X").when(text == "24", "Y").when(text.isin(MITOCHONDRIAL), "MT").otherwise(F.coalesce(whole, text))


def is_autosome(c: Column) -> Column:
    return F.coalesce(c.isin([str(i) for i in range(1, 23)]), F.lit(False))


def extracted_number(c: Column, pattern: str) -> Column:
    """The integer in the pattern's first group; null where it does not occur."""
    return F.regexp_extract(c, pattern, 1).try_cast("int")


def project_code(c: Column, prefix: str, renamed: dict[str, str] | None = None) -> Column:
    """Upper case, without the programme's prefix, old codes renamed."""
    text = F.upper(F.trim(c))
    out = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1000)).otherwise(text)
    for old, new in (renamed or {"OVCA": "OV"}).items():
        out = F.when(out == old, new).otherwise(out)
    return out


def gene_symbol(c: Column) -> Column:
    """The name before the bar, or after it where that is blank, '?' or 'NA'; quotes and versions dropped."""
    text = F.regexp_replace(F.trim(c), r'^\x{FEFF}|"', "")
    head, tail = F.substring_index(text, "|", 1), F.when(text.contains("|"), F.substring_index(text, "|", -1))
    name = F.when(head.isin("", "?", "NA"), F.coalesce(tail, head)).otherwise(head)
    return F.upper(F.trim(F.regexp_replace(name, r"\.[0-9]+$", "")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null unless whole is positive."""
    return F.when(whole > 0, part / whole)


def stable_id(*parts: Column, sep: str = "|", missing: str = "<NA>") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def reasons(pairs: Sequence[tuple[str, Column]], empty: str = "none") -> Column:
    """Names of the conditions that hold, in order, joined by ';'."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in pairs]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, empty).otherwise(F.array_join(found, ";"))


def first_match(pairs: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first condition that holds; a null condition doesn't."""
    out = F.lit(otherwise)
    for condition, label in reversed(pairs):
        out = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(out)
    return out


def segment_status(mean: Column, gain: float = 0.2, loss: float = -0.2) -> Column:
    return first_match([(mean.isNull(), "unmatched"), (mean >= gain, "gain"), (mean <= loss, "loss")], "neutral")


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters with their plain letters, by Unicode's compatible decomposition:
    for translation, and those that become several."""
    one, many = {}, {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(code)] = plain
        elif plain:
            many[chr(code)] = plain
    return "".join(one), "".join(one.values()), many


_ONE, _PLAIN, _MANY = _folds()


def plain_text(c: Column) -> Column:
    """Lower-case ASCII words. Letters fold to their plain forms; what has none goes."""
    folded = F.translate(c, _ONE, _PLAIN)
    wide = folded
    for letter, plain in _MANY.items():
        wide = F.replace(wide, F.lit(letter), F.lit(plain))
    folded = F.when(folded.rlike("[" + "".join(_MANY) + "]"), wide).otherwise(folded)
    ascii_ = F.lower(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))
    return F.coalesce(F.trim(F.regexp_replace(ascii_, "[^a-z0-9]+", " ")), F.lit(""))


#: Words that carry no diagnosis.
STOP_WORDS = ["synthetic", "differential", "diagnosis", "possible", "consider", "consideration"]


#: Fixed value: what stands between alternatives.
BETWEEN = r"(?i)\s+(?:vs\.?|versus|or)\s+|[,;/|]"


def alternatives(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct alternatives of 'a vs b, c or d' in order, cleaned of stop words."""
    pieces = F.split(F.coalesce(c, F.lit("")), BETWEEN)
    clean = F.transform(pieces, lambda p: F.array_join(F.filter(F.split(plain_text(p), " "), lambda w: ~w.isin(list(stop_words)) & (w != "")), " "))
    return F.array_distinct(F.filter(clean, lambda p: p != ""))


def has_word(text: Column, word: Column) -> Column:
    """Whether the word stands in the text as a whole, whatever characters it has."""
    literal = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.rlike(text, F.concat(F.lit(r"(?<!\w)"), literal, F.lit(r"(?!\w)")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def sorted_unique(c: Column, sep: str = ";", empty: str = "NA") -> Column:
    """Aggregate: distinct non-blank values, sorted and joined."""
    kept = F.array_sort(F.collect_set(F.when(c != "", c)))
    return F.when(F.size(kept) == 0, empty).otherwise(F.array_join(kept, sep))


def integer_like(c: Column, tolerance: float = 0.05) -> Column:
    """The nearest integer if it lies within the tolerance, else null."""
    return F.when(F.abs(c - F.round(c)) <= tolerance, F.round(c))


#: Points for burden, purity and each input, and off for each failure.
POINTS = {"burden": 40.0, "purity": 25.0, "counts": 8.0, "has_purity": 5.0, "ploidy": 5.0, "copy_number": 7.0, "segments": 10.0}
OFF = {"no_segments": 8.0, "few": 25.0, "impure": 25.0, "missing": 35.0, "no_copy_number": 12.0}


def candidate_score(count: Column, purity: Column, flags: dict[str, Column], penalties: dict[str, Column], cap: float = 1000.0) -> Column:
    """0 to 100: 40 points for log-scaled burden, 25 for purity, 8/5/5/7 for available
    inputs, 10 for segments, less 25/25/35/12 for failures and 8 without segments."""
    yes = lambda k, v: F.when(F.coalesce(flags[k], F.lit(False)), v).otherwise(0.0)
    burden = POINTS["burden"] * F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.coalesce(count.cast("double"), F.lit(0.0)))) / F.log1p(F.lit(cap)))
    pure = POINTS["purity"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(purity, F.lit(0.0))))
    total = burden + pure + yes("counts", POINTS["counts"]) + yes("purity", POINTS["has_purity"])  # from left to right, as SQL adds: ties of a rounded score depend on it
    total = sum((yes(k, POINTS[k]) for k in ("ploidy", "copy_number", "segments")), total)
    fail = lambda k, v: F.when(F.coalesce(penalties[k], F.lit(False)), v).otherwise(0.0)
    lost = F.when(F.coalesce(flags["segments"], F.lit(False)), 0.0).otherwise(OFF["no_segments"]) + sum((fail(k, OFF[k]) for k in ("few", "impure", "missing", "no_copy_number")), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total - lost))


def set_hash(values: Column, order: Column, sep: str = "\n") -> Column:
    """Aggregate: SHA-256 of the values joined in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.cast("string").alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), sep), 256)
