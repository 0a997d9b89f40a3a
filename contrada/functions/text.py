"""Columns of text: white space, labels, citations, keys, sentences and source blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators U+001C to U+001F.
_WHITE = r"(?U)[\s\x1c-\x1f]"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Marks of the blocks of a narrative.
TOKENS = {"ontologia": "[ONTOLOGIA]", "contesto": "[CONTESTO]", "speculativo": "[SPECULATIVO]"}
ARROW = " → "
#: Misspelt identifiers of the ontology and their labels.
TYPOS = {"Brank_branch": "Branch robbery", "Buiding_damage": "Building damage"}


def stripped(x) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def filled(x) -> Column:
    """Whether a text has more than white space; null has not."""
    return F.coalesce(x.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def flattened(x) -> Column:
    """On one line: runs of white space are one blank, runs of two hyphens or more are '- -'."""
    return F.regexp_replace(stripped(F.regexp_replace(x, _WHITE + "+", " ")), "-{2,}", "- -")


def local_name(iri) -> Column:
    """What stands after the last #, else after the last /."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def display(identifier) -> Column:
    """An identifier to read: blanks for underscores, the first letter in upper case."""
    x = stripped(F.translate(identifier, "_", " "))
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def english(identifier) -> Column:
    """The English label of an identifier: known misspellings are set right, the rest is as display() has it; an identifier of blanks only stays."""
    shown = F.coalesce(F.nullif(display(identifier), F.lit("")), identifier)
    for wrong, right in TYPOS.items():
        shown = F.when(identifier == wrong, right).otherwise(shown)
    return shown


def citation(cls, prop, filler) -> Column:
    return F.concat_ws(ARROW, cls, prop, filler)


def cited(path) -> Column:
    """Class, property and filler of a citation."""
    return F.split(path, ARROW)


def key(x) -> Column:
    return F.lower(stripped(x))


def slug(x) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def run_id(experiment, citta, zona, repetition=None) -> Column:
    parts = [slug(experiment), slug(citta), slug(zona)]
    base = F.concat_ws("__", *parts)
    return base if repetition is None else F.concat(base, F.format_string("__rep%02d", repetition))


def tokens(x) -> Column:
    """A careful estimate: a third of the code points, rounded up."""
    return F.ceil(F.length(x) / F.lit(3.0))


def sentences(x) -> Column:
    """Pieces between full stops and line ends, stripped; blank ones go."""
    return F.filter(F.transform(F.split(x, "[.\n]"), stripped), lambda s: s != "")


def blocks(x) -> Column:
    """overview, ontologia, contesto and speculativo of a narrative. A block goes from the line after its mark's first line to the start of the next mark's line; without marks all is overview."""
    text = F.coalesce(x, F.lit(""))

    def line_start(mark):
        before = F.substring_index(text, mark, 1)
        return F.when(F.instr(text, mark) > 0, F.length(before) - F.length(F.substring_index(before, "\n", -1)))

    starts = {k: line_start(m) for k, m in TOKENS.items()}
    # The order of marks in the text breaks ties of lines: a stable sort by line start keeps the order above.
    order = list(TOKENS)

    def block(k):
        mark = TOKENS[k]
        rest = F.substr(text, F.instr(text, mark))
        newline = F.instr(rest, "\n")
        content = F.when(newline == 0, F.length(text)).otherwise(F.instr(text, mark) - 1 + newline)
        later = [F.when((starts[o] > starts[k]) | ((starts[o] == starts[k]) & F.lit(order.index(o) > order.index(k))), starts[o]) for o in order if o != k]
        end = F.coalesce(F.least(*later), F.length(text))
        return F.when(starts[k].isNotNull(), stripped(F.substr(text, content + 1, F.greatest(end - content, F.lit(0))))).otherwise("")

    first = F.coalesce(F.least(*starts.values()), F.length(text))
    return F.struct(stripped(F.substr(text, F.lit(1), first)).alias("overview"), *[block(k).alias(k) for k in TOKENS])
