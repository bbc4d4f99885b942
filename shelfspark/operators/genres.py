"""Category cleanup: the kind of a record by label or majority, contradictions out, best supported first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Catalog categories and their kind; '' for those that are either.
CATEGORIES = (
    ("Arts & Entertainment", "nonfiction"),
    ("Biographies & Memoirs", "nonfiction"),
    ("Business & Careers", "nonfiction"),
    ("Children's Audiobooks", ""),
    ("Comedy & Humor", ""),
    ("Computers & Technology", "nonfiction"),
    ("Education & Learning", "nonfiction"),
    ("Erotica", "fiction"),
    ("Health & Wellness", "nonfiction"),
    ("History", "nonfiction"),
    ("Home & Garden", "nonfiction"),
    ("LGBTQ+", ""),
    ("Literature & Fiction", "fiction"),
    ("Money & Finance", "nonfiction"),
    ("Mystery, Thriller & Suspense", "fiction"),
    ("Politics & Social Sciences", "nonfiction"),
    ("Relationships, Parenting & Personal Development", "nonfiction"),
    ("Religion & Spirituality", "nonfiction"),
    ("Romance", "fiction"),
    ("Science & Engineering", "nonfiction"),
    ("Science Fiction & Fantasy", "fiction"),
    ("Sports & Outdoors", "nonfiction"),
    ("Teen & Young Adult", ""),
    ("Travel & Tourism", "nonfiction"),
)
# What taggers write where no category is known.
PLACEHOLDERS = ("audiobook", "audiobooks", "audio book", "audio books", "spoken word", "hörbuch", "books & spoken")


def category_kind(name: Column, kinds: dict[str, str] | None = None) -> Column:
    """fiction, nonfiction or ''."""
    kinds = kinds or {n: k for n, k in CATEGORIES if k}
    table = F.create_map(*[F.lit(x) for n, k in kinds.items() for x in (n.lower(), k)])
    return F.coalesce(F.try_element_at(table, F.lower(text.trimmed(name))), F.lit(""))


def record_kind(label: Column, paths: Column, kinds: dict[str, str] | None = None) -> Column:
    """The label where it names a kind, else the majority of the paths' first categories; '' for a tie."""
    votes = lambda k: F.size(F.filter(paths, lambda p: (F.size(p) > 0) & (category_kind(F.try_element_at(p, F.lit(1)), kinds) == k)))
    named = F.lower(text.trimmed(label))
    fiction, nonfiction = votes("fiction"), votes("nonfiction")
    return F.when(named.isin("fiction", "nonfiction"), named).when(fiction > nonfiction, "fiction").when(nonfiction > fiction, "nonfiction").otherwise("")


def cleaned(label: Column, genres: Column, sub_genres: Column, paths: Column, kinds: dict[str, str] | None = None) -> Column:
    """struct(genres, sub_genres): first categories by support without those that contradict the kind, and what lies below them.

    Without paths, the flat genres less the contradicting ones; the sub-genres stay only where none was dropped.
    """
    return text.let(record_kind(label, paths, kinds), lambda kind: _cleaned(kind, genres, sub_genres, paths, kinds))


def _cleaned(kind: Column, genres: Column, sub_genres: Column, paths: Column, kinds: dict[str, str] | None) -> Column:
    none = F.array().cast("array<string>")
    result = lambda g, s: F.struct(g.alias("genres"), s.alias("sub_genres"))
    consistent = lambda names: F.filter(names, lambda g: text.let(category_kind(g, kinds), lambda k: (kind == "") | (k == "") | (k == kind)))

    def flat(kept: Column) -> Column:
        return F.when(F.size(kept) == 0, result(genres, sub_genres)).when(F.size(kept) < F.size(genres), result(kept, none)).otherwise(result(kept, sub_genres))

    def ordered(firsts: Column) -> Column:
        def rank(keep: Column) -> Column:
            return F.transform(F.array_sort(F.transform(keep, lambda g, i: F.struct((-F.size(F.filter(firsts, lambda x: x == g))).alias("n"), i.alias("i"), g.alias("g")))), lambda r: r["g"])

        return text.let(F.array_distinct(firsts), lambda names: text.let(consistent(names), lambda keep: rank(F.when(F.size(keep) > 0, keep).otherwise(names))))

    def with_subs(order: Column) -> Column:
        below = F.flatten(F.transform(order, lambda g: F.flatten(F.transform(F.filter(paths, lambda p: F.try_element_at(p, F.lit(1)) == g), lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))))))
        return result(order, F.array_except(F.filter(below, lambda s: s != ""), order))

    firsts = F.filter(F.transform(paths, lambda p: F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(""))), lambda g: g != "")
    return F.when(F.size(paths) == 0, text.let(consistent(genres), flat)).otherwise(text.let(text.let(firsts, ordered), with_subs))


def without_placeholders(genres: Column) -> Column:
    return F.filter(genres, lambda g: ~F.lower(text.trimmed(g)).isin(*PLACEHOLDERS))


def file_genre_leads(genres: Column, file_genre: Column, label: Column, paths: Column, kinds: dict[str, str] | None = None) -> Column:
    """The file's own genre in front, unless it is unknown or contradicts the record's kind."""
    kind, own = record_kind(label, paths, kinds), category_kind(file_genre, kinds)
    fits = (file_genre != "") & ((kind == "") | (own == "") | (own == kind))
    return F.when(fits, F.concat(F.array(file_genre), F.array_remove(genres, file_genre))).otherwise(genres)
