"""Lines, trimming, prompts and the parsing of numbered summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming strips: all of Unicode's, line ends and the byte order mark.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NO_SUMMARY = "Code chunk"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Split at ``\\n`` only; a last empty line stays."""
    return F.split(text, "\n", -1)


#: Values that one sum runs over before the next one starts.
SUMMED = 256


def running_sums(values: Column) -> Column:
    """Sums of the first values of an array, for :func:`sum_before`.

    In two levels, within groups of SUMMED values and of whole groups, so that the cost hardly grows faster than the array.
    """

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    return F.transform(F.sequence(F.lit(0), (F.size(values) / SUMMED).cast("int")), lambda g: sums(F.slice(values, g * SUMMED + 1, F.lit(SUMMED))))


def group_sums(within: Column) -> Column:
    """The second level of :func:`running_sums`: the sums of whole groups before each group."""
    return F.aggregate(within, F.array(F.lit(0).cast("long")), lambda s, g: F.concat(s, F.array(F.element_at(s, -1) + F.element_at(g, -1))))


def sum_before(within: Column, before: Column, k: Column) -> Column:
    """The sum of the first ``k`` values."""
    group = (k / SUMMED).cast("int")
    return F.get(before, group) + F.get(F.get(within, group), (k % SUMMED).cast("int"))


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def strip_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def parse_summaries(response: Column, n: Column) -> Column:
    """Summaries 1 to n of a numbered response: the first line ``[i] text`` of each i, else a default.

    Thinking tags, blank lines and lines that begin with ``<`` don't count; of a response of fewer than 10
    characters nothing does.
    """
    body = trim(strip_thinking(F.coalesce(response, F.lit(""))))
    kept = F.filter(F.transform(lines(body), trim), lambda l: (l != "") & ~l.startswith("<"))
    usable = F.when(F.length(body) < 10, F.array().cast("array<string>")).otherwise(kept)

    def one(i: Column) -> Column:
        pattern = F.concat(F.lit(r"^\["), i.cast("string"), F.lit(r"\]\s*.+$"))
        found = F.get(F.filter(usable, lambda l: F.regexp_like(l, pattern)), F.lit(0))
        return F.coalesce(trim(F.regexp_replace(found, r"^\[\d+\]\s*", "")), F.lit(NO_SUMMARY))

    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), one))


def parse_summaries_standalone(response: str | None, n: int) -> list[str]:
    """The variant of single requests: an i without a line takes the first line that holds no summary chosen before.

    Each choice depends on those before it, so this is a function of one response.
    """
    import re

    body = re.sub(r"<think>.*?</think>", "", response or "", flags=re.I | re.S).strip(SPACES)
    if len(body) < 10:
        return [NO_SUMMARY] * n
    usable = [l for l in (x.strip(SPACES) for x in body.split("\n")) if l and not l.startswith("<")]
    out: list[str] = []
    for i in range(1, n + 1):
        found = next((m[1].strip(SPACES) for l in usable if (m := re.match(rf"\[{i}\]\s*(.+)$", l))), None)
        if found is None:
            rest = [l for l in usable if not any(s in l for s in out)]
            found = re.sub(r"^\[\d+\]\s*", "", rest[0]).strip(SPACES) if rest else ""
        out.append(found or NO_SUMMARY)
    return out


def chunk_prompt(codes: Column) -> Column:
    """The numbered chunks of a summary prompt, from an ordered array of code."""
    return F.array_join(
        F.transform(codes, lambda c, i: F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit("]\n"), c, F.lit("\n"))), "\n"
    )


def token_usage(texts: Column) -> Column:
    """Number of parts that white space cuts an array of texts into, joined by a space."""
    return F.size(F.split(F.array_join(texts, " "), r"\s+", -1))


def contextualized(path: Column, parent: Column, type_: Column, name: Column, parameters: Column, returns: Column, text: Column) -> Column:
    """Text to embed: what is known of a chunk, a line each, then its code."""

    def line(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))

    known = F.array(
        F.concat(F.lit("File: "), path),
        line("Parent: ", parent),
        F.when(name.isNotNull() & (name != ""), F.concat(type_, F.lit(": "), name)),
        line("Parameters: ", F.array_join(parameters, ", ")),
        line("Returns: ", returns),
        F.lit("---"),
        text,
    )
    return F.array_join(F.filter(known, lambda l: l.isNotNull()), "\n")


def _named(type_: Column, name: Column) -> Column:
    return F.concat(F.lit("["), type_, F.lit("] "), F.coalesce(name, F.lit("(anonymous)")))


def text_chunk_string(type_: Column, name: Column, line_start: Column, line_end: Column, char_count: Column) -> Column:
    """How a chunk with its text is shown."""
    lines_ = F.format_string(" (lines %d-%d, %d chars)", line_start, line_end, char_count)
    return F.concat(_named(type_, name), lines_)


def hashed_chunk_string(type_: Column, name: Column, path: Column, line_start: Column, line_end: Column, hash_: Column) -> Column:
    """How a chunk without its text is shown."""
    place = F.format_string(" @ %s:%d-%d (hash: %s...)", path, line_start, line_end, F.substring(hash_, 1, 8))
    return F.concat(_named(type_, name), place)
