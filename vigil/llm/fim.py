"""Fill-in-the-middle by counted quantifiers.

A text is a row of units: runs of the letters A to Z in either case, and every
other code point. ``regexp_count`` gives their number n; two cut points, from
hashes of the document's id, are put into a pattern of the row's own,

    (unit{a}) (unit{b - a}) (rest)

whose counted groups are possessive, so they never give units back and the
engine works through them in a loop, however many there are. One replacement
of the one match writes prefix, suffix and middle in the order of the form:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Everything is a column expression over one row: no shuffle, no Python.

Defined results: a null text is empty; an empty text, or one that holds a
sentinel, is plain (given as it is), so every transformed text can be taken
apart again without doubt; a null id has the hash of an empty number; the
result has named columns only, so other columns and their names do not matter;
repeated rows give the same row again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same units where a group may not give letters back.
GROUPED = "(?:[A-Za-z]++|[^A-Za-z])"


@dataclass(frozen=True)
class Fim:
    """Sentinels, and the shares: of texts transformed, and of those in the order spm."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed_percent: int = 90
    spm_percent: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        marks = [self.prefix, self.suffix, self.middle]
        # a mark that starts as it begins anywhere later could be formed by a text and a mark together
        if len(set(marks)) < 3 or not all(m and m[0] not in m[1:] and m[0] == marks[0][0] and m[-1] == marks[0][-1] and m[-1] not in m[:-1]
                                          and not set(m) & set("\\$") and len(m) == len(marks[0]) for m in marks):
            raise ValueError("sentinels must be distinct, of one length, and share a first and a last sign found nowhere else in them")


def numbers(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of 8 hex digits of SHA-256 over ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: Fim = Fim()) -> DataFrame:
    """(<id>, n long, form string, output string, prefix_chars long, middle_chars long)."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    h1, h2, h3, h4 = numbers(F.col(rows.columns[0]), fim.seed)
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    points = F.col("n") + 1
    marked = F.contains("_text", F.lit(fim.prefix)) | F.contains("_text", F.lit(fim.suffix)) | F.contains("_text", F.lit(fim.middle))
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= fim.transformed_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < fim.spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn("_a", F.least(h1 % points, h2 % points)).withColumn("_b", F.greatest(h1 % points, h2 % points))

    def counted(count: Column) -> Column:
        return F.concat(F.lit(f"({GROUPED}{{"), count.cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.col("_a")), counted(F.col("_b") - F.col("_a")), F.lit(r"(.*)\z"))
    orders = F.when(F.col("form") == "spm", f"{fim.suffix}$3{fim.prefix}$1{fim.middle}$2").otherwise(
        f"{fim.prefix}$1{fim.suffix}$3{fim.middle}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, orders)))

    # a text without sentinels forms none with those around it, so the first found is the one written
    mark = len(fim.prefix)
    at = {m: F.instr(F.col("output"), F.lit(m)) for m in (fim.prefix, fim.suffix, fim.middle)}
    before = F.when(F.col("form") == "psm", at[fim.suffix] - at[fim.prefix]).when(F.col("form") == "spm", at[fim.middle] - at[fim.prefix])
    after = F.when(F.col("form") != "plain", F.char_length("output") - at[fim.middle] + 1)
    return rows.select(F.col(rows.columns[0]), "n", "form", "output", (before - mark).cast("long").alias("prefix_chars"),
                       (after - mark).cast("long").alias("middle_chars"))


def restore(output: Column, form: Column, fim: Fim = Fim()) -> Column:
    """The text that ``transform`` was given."""
    def apart(first: str, second: str) -> str:
        return rf"(?s)\A\Q{first}\E(.*?)\Q{second}\E(.*?)\Q{fim.middle}\E(.*)\z"

    return F.when(form == "psm", F.regexp_replace(output, apart(fim.prefix, fim.suffix), "$1$3$2")).when(
        form == "spm", F.regexp_replace(output, apart(fim.suffix, fim.prefix), "$2$3$1")).otherwise(output)


def digest(found: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """Texts as their SHA-256: (<id>, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return found.select(found.columns[0], "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restore(F.col("output"), F.col("form"), fim), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The digests by slices of the list of units (DuckDB)."""
    def h(i: int) -> str:
        return f"('0x' || substr(sha, {1 + 8 * i}, 8))::BIGINT"

    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}', 0, 's') AS units,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents),
p AS (SELECT *, len(units) AS n, least({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS a,
        greatest({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h(2)} % 100 >= 90 THEN 'plain'
             WHEN {h(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
q AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM q"""
