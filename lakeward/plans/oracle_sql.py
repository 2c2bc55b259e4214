"""SQL fragments shared by oracle queries (DuckDB dialect)."""

from __future__ import annotations

from lakeward.functions import vocab


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def is_global(viewer: str) -> str:
    v = q(viewer)
    return (
        f"(coalesce((SELECT bool_or(is_superadmin) FROM users WHERE email = {v}), false) "
        f"OR EXISTS (SELECT 1 FROM team_members tm JOIN teams t ON tm.team_id = t.id "
        f"WHERE tm.email = {v} AND t.is_platform))"
    )


def visible_assets(viewer: str | None) -> str:
    """Subquery: assets (+ team_id, domain_name) the viewer may see."""
    base = ("SELECT a.*, d.team_id, d.name AS domain_name FROM assets a "
            "JOIN domains d ON a.domain_id = d.id")
    if viewer is None:
        return f"({base} WHERE a.published)"
    return (f"({base} WHERE a.published OR {is_global(viewer)} "
            f"OR d.team_id IN (SELECT team_id FROM team_members WHERE email = {q(viewer)}))")


def visible_domains(viewer: str) -> str:
    return (
        f"(SELECT d.* FROM domains d WHERE {is_global(viewer)} UNION ALL "
        f"SELECT d.* FROM domains d JOIN team_members tm ON d.team_id = tm.team_id "
        f"WHERE tm.email = {q(viewer)} AND NOT {is_global(viewer)})"
    )


def like_contains(text: str) -> str:
    """``'%text%'`` with wildcards in text left live (DuckDB ILIKE has no escape)."""
    return q("%" + text + "%")


FLAGS = """(SELECT coalesce(u.email, p.email) AS email,
    coalesce(u.is_superadmin, false) AS is_superadmin,
    coalesce(p.is_platform, false) AS is_platform,
    coalesce(u.is_superadmin, false) OR coalesce(p.is_platform, false) AS is_global
  FROM (SELECT email, bool_or(coalesce(is_superadmin, false)) AS is_superadmin FROM users GROUP BY email) u
  FULL OUTER JOIN (SELECT DISTINCT tm.email, true AS is_platform FROM team_members tm
                   JOIN teams t ON tm.team_id = t.id WHERE t.is_platform) p
  ON u.email = p.email)"""

VIEWERS = "(SELECT DISTINCT email AS viewer FROM users UNION ALL SELECT NULL AS viewer)"


def source_family(column: str) -> str:
    """The family of a source type, as a CASE over the fixed values."""
    whens = " ".join(f"WHEN {q(source)} THEN {q(family)}" for source, family in vocab.SOURCE_FAMILIES.items())
    return f"coalesce(CASE lower({column}) {whens} END, {q(vocab.DEFAULT_FAMILY)})"


def type_vocabulary() -> str:
    """(vocab_key, type) rows of the fixed type lists: by source, by file format, and the default."""
    rows = [(source, ty) for source, types in vocab.SOURCE_TYPE_VOCABULARY.items() for ty in types]
    rows += [(f"format:{name}", ty) for name, types in vocab.FILE_FORMAT_VOCABULARY.items() for ty in types]
    rows += [("", ty) for ty in vocab.DEFAULT_TYPES]
    return ", ".join(f"({q(key)}, {q(ty)})" for key, ty in rows)


OWN_LIST = ", ".join(q(source) for source in vocab.SOURCE_TYPE_VOCABULARY)
