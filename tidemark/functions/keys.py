"""Keys from sequence strings: residues, terminals, linkages, and page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


# How the sections of a sequence are cut into residues and linkages.
RESIDUE = r"\[([^\]]+)\]"
RESIDUE_DETAILS = (r"_\d+\*.*", r"\d+\*", r"/.*")
LINKAGE = r"[a-z]\d+-[a-z]\d+"
PLAIN_LINKAGE = r"[ab]\d+-\d+"
TOPOLOGY, RESIDUES, CONNECTIONS = 2, 3, 4  # sections between slashes, from 0; a slash inside a residue shifts them
CORE_WIDTH = 10


def section(sequence: Column, index: int) -> Column:
    """One section of a sequence; null where it has fewer."""
    return F.try_element_at(F.split(sequence, "/"), F.lit(index + 1))


def joined(found: Column) -> Column:
    return F.array_join(F.array_sort(found), ",")


def residues(part: Column) -> Column:
    """Contents of all square brackets of a residue section."""
    return F.regexp_extract_all(part, F.lit(RESIDUE), F.lit(1))


def core_residues(part: Column) -> Column:
    """Residues without modifications and positions, cut to their core, sorted and joined."""

    def core(x: Column) -> Column:
        for pattern in RESIDUE_DETAILS:
            x = F.regexp_replace(x, pattern, "")
        return F.substring(x, 1, CORE_WIDTH)

    return joined(F.transform(residues(part), core))


def scaffold(sequence: Column) -> Column:
    """Core residues and topology; null where there is no residue section."""
    part = section(sequence, RESIDUES)
    return F.when(part.isNotNull(), F.concat(core_residues(part), F.lit("|"), section(sequence, TOPOLOGY)))


def terminals(sequence: Column) -> Column:
    """The last two residues, sorted and joined; null where there is no connection section."""
    a = residues(section(sequence, RESIDUES))
    last = F.when(F.size(a) >= 2, F.slice(a, -2, 2)).otherwise(a)
    return F.when(section(sequence, CONNECTIONS).isNotNull(), joined(last))


def linkages(sequence: Column) -> Column:
    """Distinct linkages of the connection section, sorted and joined; null where there is none."""
    return linkages_in(section(sequence, CONNECTIONS), LINKAGE)


def linkages_in(part: Column, pattern: str) -> Column:
    return joined(F.array_distinct(F.regexp_extract_all(part, F.lit(pattern), F.lit(0))))


def key_cascade(kind: str, id_: Column, **candidates: Column) -> Column:
    """`<source>_<kind>_` and the hash of the first candidate that is neither null nor empty, else a fallback by id."""
    found = [F.concat(F.lit(f"{source}_{kind}_"), short_hash(F.nullif(c, F.lit("")))) for source, c in candidates.items()]
    return F.coalesce(*found, F.concat(F.lit(f"fallback_{kind}_"), F.substring(id_, 1, 8)))


def structure_keys(df: DataFrame, key: str, wurcs: str, iupac: str) -> DataFrame:
    """`df` with scaffold_key, terminal_motif_key and linkage_key, from the WURCS sequence, else the IUPAC one, else the id."""
    w, i, name = F.nullif(F.col(wurcs), F.lit("")), F.nullif(F.col(iupac), F.lit("")), F.col(key).cast("string")
    return df.withColumns({
        "scaffold_key": key_cascade("scaffold", name, wurcs=scaffold(w), iupac=plain_scaffold(i)),
        "terminal_motif_key": key_cascade("terminal", name, wurcs=terminals(w), iupac=plain_terminals(i)),
        "linkage_key": key_cascade("linkage", name, wurcs=linkages(w), iupac=plain_linkages(i)),
    })


def links(html: Column) -> Column:
    """Targets of all anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))


def join_url(base: Column, link: Column) -> Column:
    """Absolute form of a link: absolute links stay, rooted ones get scheme and host, others the base's folder."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def plain_scaffold(c: Column) -> Column:
    """A condensed sequence with every linkage as x-x, without anomer letters and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PLAIN_LINKAGE, "x-x"), "[αβ]", ""), r"\s+", "")


def plain_terminals(c: Column) -> Column:
    """Last capitalised name of each part between square brackets, distinct, sorted and joined."""
    parts = F.transform(F.split(c, r"[\[\]]"), lambda p: F.try_element_at(F.regexp_extract_all(p, F.lit("[A-Z][a-z]*"), F.lit(0)), F.lit(-1)))
    return joined(F.array_distinct(F.filter(parts, lambda p: p.isNotNull())))


def plain_linkages(c: Column) -> Column:
    return linkages_in(c, PLAIN_LINKAGE)
