"""Text functions: Column to Column, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin and Devanagari letters (the danda is in the Devanagari block).
LETTERS = r"A-Za-zऀ-ॿ"
DEVANAGARI = r"ऀ-ॿ"
SENTENCE_END = "।!?."


def tokenize(text: Column) -> Column:
    """Lower-case runs of Latin or Devanagari letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTERS}]+)"), 1)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def speech_tokens(text: Column) -> Column:
    """Words with apostrophes and hyphens, else single signs."""
    return F.regexp_extract_all(text, F.lit(rf"([{LETTERS}'\-]+|[^\s{LETTERS}])"), 1)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is named: it is bound as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def drop_repeats(tokens: Column) -> Column:
    """Tokens without those that equal the one before."""
    return once(tokens, lambda own: F.filter(own, lambda t, i: (i == 0) | (t != F.get(own, i - 1))))


def most_repeated(tokens: Column) -> Column:
    """How often the most frequent token occurs: the longest run of equals in sorted order; 0 without tokens."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(t), s["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["best"])


def script_of(token: Column) -> Column:
    """hin for any Devanagari letter, eng for any Latin one, else sil."""
    return F.when(token.rlike(f"[{DEVANAGARI}]"), "hin").when(token.rlike("[A-Za-z]"), "eng").otherwise("sil")


def language_tag(text: Column) -> Column:
    """hin_Deva if there are at least as many Devanagari as Latin runs, else eng_Latn."""
    deva = F.regexp_count(text, F.lit(f"[{DEVANAGARI}]+"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]+"))
    return F.when(deva >= latin, "hin_Deva").otherwise("eng_Latn")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _parts(text: Column, pattern: str) -> Column:
    """The matches of a pattern, stripped, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), stripped), lambda s: s != "")


def sentence_pattern(longest: int = 200) -> str:
    """One sentence from where the last ended: what reaches beyond `longest` characters before an end sign goes to
    the end of its run (of line ends, or of other characters); else all up to and with the end signs, or the rest."""
    end = SENTENCE_END
    return rf"[^{end}]{{{longest}}}(?:\n+|[^{end}\n]+)|[^{end}]{{0,{longest}}}[{end}]+|[^{end}]+"


def sentences(text: Column, longest: int = 200) -> Column:
    """Sentences with their end signs; a piece without one closes a sentence only beyond `longest` characters.

    The text is cut before and behind runs of end signs and of line ends, as pieces that are added to a
    buffer one by one; the buffer is given out when it ends in an end sign or has grown too long. One
    pattern says the same without a buffer, so that the work follows the text's length.
    """
    return _parts(text, sentence_pattern(longest))


def chunk_pattern(longest: int = 240) -> str:
    """Up to the first end of a run of end signs that is `longest` characters or more away, or the rest."""
    end = SENTENCE_END
    return rf"(?s:.{{{longest - 1}}}[^{end}]*[{end}]+|.+)"


def spoken_chunks(text: Column, longest: int = 240) -> Column:
    """Pieces added up until a chunk has `longest` characters and ends in an end sign."""
    return _parts(text, chunk_pattern(longest))


def short_pattern(most: int) -> str:
    """What is left if it has `most` characters, else up to the last blank before that many, or that many."""
    return rf"(?s:\s*(?:.{{1,{most}}}\z|.{{1,{most - 1}}} |.{{{most}}}))"


def short_chunks(text: Column, most: int = 220) -> Column:
    """Spoken chunks of `most` characters on, those that are longer cut at the last blank below it or hard."""
    end = SENTENCE_END
    # white space between end signs is a piece too, and closes a chunk that it makes long enough
    blank = rf"(?s:.{{{most}}}(?<=[{end}]\s{{1,{most - 1}}})\s*(?=[{end}]))"
    chunks = _parts(text, f"{blank}|{chunk_pattern(most)}")
    return F.flatten(F.transform(chunks, lambda c: _parts(c, short_pattern(most))))


def _collapsed_runs(joined: Column, run: int, longest: int, keep: int) -> Column:
    """Tokens between single blanks, runs of equal ones shrunk."""
    return F.regexp_replace(joined, rf"(?<![^ ])(\S{{1,{longest}}})(?: \1){{{run - 1},}}(?![^ ])", " ".join(["$1"] * keep))


def collapse_token_runs(tokens: Column, run: int = 5, longest: int = 10, keep: int = 2) -> Column:
    """Runs of at least `run` equal tokens of at most `longest` characters shrink to `keep`. Tokens hold no white space."""
    shrunk = F.split(_collapsed_runs(F.array_join(tokens, " "), run, longest, keep), " ")
    return F.when(F.size(tokens) > 0, shrunk).when(tokens.isNotNull(), F.array().cast("array<string>"))


# The clean-up patterns that results depend on.
GLUED = rf"((?:([{LETTERS}]{{1,8}})[-–])((?:[{LETTERS}]{{1,8}})[-–])(?:[{LETTERS}]{{1,8}}[-–]){{2,}})"
SIGN_RUN = rf"(\s*([{SENTENCE_END}]\s*)){{5,}}"
BRACKETS = r"(\([^\(\)]{1,12}\)\s*){4,}"
CHARACTER_RUN = r"(.)\1{6,}"


def collapse_repeats(text: Column) -> Column:
    """Glued repeats, token runs, runs of end signs, of brackets and of single characters, in this order."""
    glued = F.regexp_replace(text, GLUED, "$2-$3")
    joined = _collapsed_runs(F.btrim(F.regexp_replace(glued, r"\s+", " ")), 5, 10, 2)
    signs = F.regexp_replace(joined, SIGN_RUN, ". . ")
    brackets = F.regexp_replace(signs, BRACKETS, "$1$1")
    return stripped(F.regexp_replace(brackets, CHARACTER_RUN, "$1$1$1"))


#: Placeholders of a sentence go up to this number.
LAST_TERM = 50


def protect_terms(text: Column, terms: list[tuple[str, str]]) -> Column:
    """struct<masked: string, glosses: map<string, string>>: known terms replaced by placeholders ⟦T0⟧, ⟦T1⟧, ..., and the placeholders' glosses.

    Terms are tried by length, the longest first, equals in the order given, in any case and not inside a run of
    letters; those found are numbered in this order, and beyond LAST_TERM the rest of the sentence is
    left alone. The dictionary is a list on the driver; a sentence is matched with the terms that its
    lower-case text holds only.
    """
    ordered = sorted((t for t in terms if t[0]), key=lambda t: -len(t[0]))
    known = F.array(*[F.struct(F.lit(t.lower()).alias("low"), F.lit(rf"(?iu)(?<![{LETTERS}])\Q{t}\E(?![{LETTERS}])").alias("pattern"), F.lit(g).alias("gloss")) for t, g in ordered])
    start = F.struct(text.alias("masked"), F.array().cast("array<struct<key: string, value: string>>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        tag = F.concat(F.lit("⟦T"), F.size(s["found"]).cast("string"), F.lit("⟧"))
        entry = F.array(F.struct(tag.alias("key"), t["gloss"].alias("value")))
        replaced = F.regexp_replace(s["masked"], t["pattern"], tag)
        changed = once(replaced, lambda r: F.when(r != s["masked"], F.struct(r.alias("masked"), F.concat(s["found"], entry).alias("found"))).otherwise(s))
        return F.when(F.size(s["found"]) <= LAST_TERM, changed).otherwise(s)

    there = once(F.lower(text), lambda low: F.filter(known, lambda t: F.contains(low, t["low"])))
    return F.aggregate(there, start, step, lambda s: F.struct(s["masked"].alias("masked"), F.map_from_entries(s["found"]).alias("glosses")))


def restore_terms(text: Column, terms: Column) -> Column:
    """Each placeholder of the map `terms` replaced by its gloss."""
    return F.aggregate(F.map_entries(terms), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))
