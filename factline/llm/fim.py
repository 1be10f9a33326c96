"""Fill-in-the-middle: a text is cut into units, its middle moved behind its prefix and suffix.

A unit grammar says between which neighbouring classes of characters a unit ends. It becomes a regex without width, a
lookbehind for the class on the left and a lookahead for that on the right, so that Spark's split() loses no character:
the pieces joined are the text. An empty text has no unit, where split() would give one empty piece.

The two cuts and the form are drawn from sha256 of the seed and the document's id, so reruns agree on any partitions. All
is column expressions; a row's work and memory grow with its own text, and nothing is shuffled.

Edge cases: a null text is empty, and empty texts stay plain; a text that contains one of the sentinels stays plain,
so that the text can be rebuilt from output and form; a null id is drawn for as an empty one; repeated ids draw alike;
result columns take free names where the table has columns of theirs; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.text import free_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Grammar:
    """Units end wherever a character of the left class stands before one of the right class, for any of `ends`."""

    ends: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """A regex that matches, without width, where a unit ends and another begins."""
        return "|".join(f"(?<={left})(?={right})" for left, right in self.ends)


ANY = r"[\s\S]"
GRAMMARS = {
    "tokens": Grammar(((OTHER, SPACE),)),  # spaces and the word after them; spaces at the end
    "words": Grammar(((SPACE, OTHER),)),  # a word and the spaces after it
    "runs": Grammar(((SPACE, OTHER), (OTHER, SPACE))),  # words and spaces apart
    "lines": Grammar(((r"\n", ANY),)),  # a line with its line feed
    "characters": Grammar(((ANY, ANY),)),
}


def units(text: Column, grammar: str = "tokens") -> Column:
    """The units of a text, in order; they join to the text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GRAMMARS[grammar].boundary(), -1))


def drawn(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2^32 that the seed and the id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def restored(output: Column, form: Column) -> Column:
    """The text, from what transform() made of it and the form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    order = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)


def transform(docs: DataFrame, grammar: str = "tokens", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs` with fim_units (how many), fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars and fim_text.

    rate: percent of texts that are moved; spm_rate: percent of these with the suffix first.
    """
    name = {c: free_name(c, docs.columns) for c in ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text", "fim_h", "fim_pieces", "fim_cuts", "fim_parts")}
    col = {c: F.col(n) for c, n in name.items()}
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({name["fim_pieces"]: units(F.col("text"), grammar), name["fim_h"]: drawn(F.col("doc_id"), seed)})
    n = F.size(col["fim_pieces"])
    h = [F.get(col["fim_h"], F.lit(i)) for i in range(4)]
    taken = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | taken | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    cuts = F.array_sort(F.array(*[(h[i] % (n + 1)).cast("int") for i in (0, 1)]))
    df = df.withColumns({name["fim_units"]: n.cast("long"), name["fim_form"]: form, name["fim_cuts"]: cuts})
    at = [F.get(col["fim_cuts"], F.lit(i)) for i in (0, 1)]
    joined = lambda begin, count: F.array_join(F.slice(col["fim_pieces"], begin + 1, count), "")
    parts = F.array(joined(F.lit(0), at[0]), joined(at[0], at[1] - at[0]), joined(at[1], F.size(col["fim_pieces"]) - at[1]))
    moved = col["fim_form"] != "plain"
    df = df.withColumn(name["fim_parts"], F.when(moved, parts)).drop(name["fim_pieces"])
    prefix, middle, suffix = (F.get(col["fim_parts"], F.lit(i)) for i in range(3))
    output = F.when(col["fim_form"] == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(col["fim_form"] == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    df = df.withColumns({name["fim_prefix_chars"]: F.char_length(prefix).cast("long"), name["fim_middle_chars"]: F.char_length(middle).cast("long"), name["fim_text"]: output})
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], *[name[c] for c in ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of transform()."""
    out = transform(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        sha(F.col("fim_text")).alias("output_sha256"), sha(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"),
    )


assert not re.search(r"[\\\[\]]", PREFIX + SUFFIX + MIDDLE)
