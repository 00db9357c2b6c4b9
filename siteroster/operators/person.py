"""Contact person and position of a parsed page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.email import name_from_email
from siteroster.functions.names import (
    NAME_IN_TEXT,
    ROLE_PATTERN,
    extract_role,
    is_person_name,
    is_valid_role,
    normalize_role,
    role_in,
)
from siteroster.functions.text import first, first_where, let, present, string_array, strip
from siteroster.operators.html import (
    all_nodes,
    all_pieces,
    class_matches,
    descendants,
    first_node,
    node_pieces,
    node_stripped,
    where_nodes,
)
from siteroster.operators.jsonld import given, is_object, member, text_member

_TYPE = "struct<name:string,role:string,line:string>"


def _candidate(name: Column, role: Column | None = None, line: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        (none if role is None else role).alias("role"),
        (none if line is None else line).alias("line"),
    ).cast(_TYPE)


def _names_in(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(NAME_IN_TEXT), F.lit(0))


def _from_meta() -> Column:
    tag = first_node(lambda n: (n["tag"] == "meta") & (n["name"] == "author"))
    return F.array(_candidate(strip(tag["content"])))


def _from_jsonld() -> Column:
    """Named persons of Person and Organization objects."""

    def read(item: Column) -> Column:
        is_person = text_member(item, "@type") == "Person"
        title = given(member(item, "jobTitle"))
        about = F.coalesce(title, given(member(item, "description")))
        role = F.try_variant_get(about, "$", "string")
        role = F.when((F.schema_of_variant(about) == "STRING") & is_valid_role(role), role)
        linked = F.coalesce(*[given(member(item, k)) for k in ("founder", "employee", "member")])
        linked_name = F.when(
            is_object(linked) & (text_member(linked, "@type") == "Person"),
            text_member(linked, "name"),
        )
        return F.array(
            _candidate(F.when(is_person, text_member(item, "name")), role),
            _candidate(linked_name),
        )

    def wanted(item: Column) -> Column:
        return text_member(item, "@type").isin("Person", "Organization")

    return F.flatten(F.transform(F.filter(F.col("jsonld"), wanted), read))


def _from_mailbox() -> Column:
    return F.transform(F.col("emails"), lambda e: _candidate(name_from_email(e)))


def _near_email() -> Column:
    lines = F.filter(F.col("lines"), lambda ln: ln.contains("@"))
    return F.flatten(
        F.transform(
            lines,
            lambda ln: F.transform(_names_in(ln), lambda n: _candidate(n, line=ln)),
        )
    )


def _in_context() -> list[Column]:
    """One list per contextual pattern: pattern order goes before line order."""
    stages = []
    for pattern in fv.PERSON_PATTERNS:
        java = f"(?U){pattern}"
        carries_role = pattern in fv.PERSON_PATTERNS[-2:]

        def read(line: Column) -> Column:
            name = strip(F.regexp_extract(line, java, 1))
            if carries_role:
                return _candidate(name, strip(F.regexp_extract(line, java, 2)))
            return _candidate(name, line=line)

        stages.append(F.transform(F.filter(F.col("lines"), lambda ln: ln.rlike(java)), read))
    return stages


def _on_role_line() -> Column:
    lines = F.filter(F.col("lines"), lambda ln: ln.rlike(ROLE_PATTERN))
    return F.flatten(
        F.transform(
            lines,
            lambda ln: let(
                normalize_role(role_in(ln)),
                lambda role: F.transform(_names_in(ln), lambda n: _candidate(n, role)),
            ),
        )
    )


# -- team pages --------------------------------------------------------------
def _tagged(n: Column, tags: Sequence[str]) -> Column:
    return n["tag"].isin(list(tags))


def _member_blocks(words: Sequence[str]) -> Column:
    """Name heading plus role text inside a team-like container."""

    def read(box: Column) -> Column:
        inside = descendants(box)
        heading = first_where(inside, lambda n: _tagged(n, ["h2", "h3", "h4", "h5", "strong", "b"]))

        def with_heading(head: Column) -> Column:
            by_class = first_where(
                descendants(box),
                lambda n: _tagged(n, ["p", "span", "small", "em", "div"])
                & class_matches(n, fv.ROLE_CLASS_PATTERN),
            )
            parent = F.get(all_nodes(), F.when(head["parent_id"] >= 0, head["parent_id"]))
            sibling = first_where(
                descendants(parent),
                lambda n: (n["parent_id"] == head["parent_id"])
                & (n["node_id"] > head["node_id"])
                & _tagged(n, ["p", "span", "small", "em"]),
            )
            loose = first_where(descendants(box), lambda n: _tagged(n, ["p", "span", "small"]))
            role_node = F.coalesce(by_class, sibling, loose)
            line = node_stripped(parent)

            def split_at(sep: Column) -> Column:
                at = F.instr(line, sep)
                left, right = line.substr(F.lit(1), at - 1), line.substr(at + 1, F.length(line))
                return F.when((at > 0) & is_person_name(strip(left), words), role_in(right))

            split_role = first_where(
                F.transform(string_array(fv.ROLE_SEPARATORS), split_at), lambda r: r.isNotNull()
            )
            role = F.when(
                role_node.isNotNull(),
                F.coalesce(role_in(node_stripped(role_node)), split_role),
            )
            return _candidate(node_stripped(head), normalize_role(role))

        return F.when(heading.isNotNull(), let(heading, with_heading))

    boxes = where_nodes(
        lambda n: _tagged(n, ["div", "li", "article"]) & class_matches(n, fv.MEMBER_CLASS_PATTERN)
    )
    return F.transform(boxes, read)


def _table_rows() -> Column:
    """First cell a name, second cell holding a role."""

    def read(row: Column) -> Column:
        return let(
            F.filter(descendants(row), lambda n: n["tag"] == "td"),
            lambda cells: F.when(
                F.size(cells) >= 2,
                _candidate(
                    node_stripped(F.get(cells, F.lit(0))),
                    normalize_role(role_in(node_stripped(F.get(cells, F.lit(1))))),
                ),
            ),
        )

    return F.transform(where_nodes(lambda n: n["tag"] == "tr"), read)


def _team_sections(words: Sequence[str]) -> Column:
    """Name line followed, within three lines and before any other name, by a role line."""
    headings = string_array(fv.TEAM_HEADINGS)

    def is_heading(text: Column) -> Column:
        return F.array_contains(headings, F.lower(text))

    def headings_at(level: str) -> Column:
        return where_nodes(lambda n: (n["tag"] == level) & is_heading(node_stripped(n)))

    tagged = [headings_at(level) for level in ("h1", "h2", "h3", "h4")]
    parents = F.array_distinct(F.transform(F.concat(*tagged), lambda n: n["parent_id"]))

    def read(parent: Column) -> Column:
        node = F.get(all_nodes(), F.when(parent >= 0, parent))
        strings = F.coalesce(node_pieces(node), all_pieces())
        lines = present(F.transform(F.split(F.array_join(strings, "\n"), "\n"), strip))
        judged = F.transform(
            lines,
            lambda ln: F.struct(
                ln.alias("line"), is_person_name(ln, words).alias("named"), role_in(ln).alias("role")
            ),
        )

        def scan(rows: Column) -> Column:
            begin = F.coalesce(
                first(
                    F.filter(
                        F.transform(rows, lambda r, i: F.when(is_heading(r["line"]), i)),
                        lambda i: i.isNotNull(),
                    )
                ),
                F.lit(1),
            )

            def pair(row: Column, i: Column) -> Column:
                one, two, three = (F.get(rows, i + k) for k in (1, 2, 3))
                role = F.coalesce(
                    one["role"],
                    F.when(~one["named"], two["role"]),
                    F.when(~one["named"] & ~two["named"], three["role"]),
                )
                return F.when(
                    (i >= begin) & row["named"], _candidate(row["line"], normalize_role(role))
                )

            return F.transform(rows, pair)

        return let(judged, scan)

    return F.flatten(F.transform(parents, read))


def team(words: Sequence[str]) -> Column:
    """Candidates from team structures; a name without a role does not count."""
    found = F.concat(_member_blocks(words), _table_rows(), _team_sections(words))
    return F.filter(found, lambda c: c["role"].isNotNull())


def contact_person(words: Sequence[str] = ()) -> Column:
    """Struct (name, role) of the first valid candidate; both null when none."""
    # each stage is worked out only where the ones before it found nobody
    stages = [
        F.concat(_from_meta(), _from_jsonld(), _from_mailbox()),
        _near_email(),
        team(words),
        F.concat(*_in_context()),
        _on_role_line(),
    ]
    chosen = F.coalesce(*[
        first_where(stage, lambda c: is_person_name(c["name"], words)) for stage in stages
    ])
    return let(
        chosen,
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(c["role"], extract_role(c["line"], c["name"])).alias("role"),
        ),
    )
