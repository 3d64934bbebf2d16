"""Oracle SQL (DuckDB) for the audits, generated from the same constraint specs
(sources/schema.py) in SQL's own idiom: GROUP BY ... HAVING, NOT EXISTS,
CHECK-style predicates, FILTER counts.
"""

from __future__ import annotations

from ..sources.schema import LINK_COLUMNS, ROLE_LINKS, TABLES
from .sql_domain import decide_sql


def _key(cols, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return "concat_ws('|', " + ", ".join(
        f"coalesce(CAST({p}{c} AS VARCHAR), '')" for c in cols) + ")"


def _dups(table: str, cols, rule: str) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT '{rule}' AS rule, '{table}' AS table_name, {_key(cols)} AS key, "
            f"'rows=' || CAST(count(*) AS VARCHAR) AS detail FROM {table} "
            f"WHERE {present} GROUP BY {', '.join(cols)} HAVING count(*) > 1")


def _pk() -> str:
    parts = []
    for spec in TABLES.values():
        parts.append(_dups(spec.name, spec.primary_key, "pk_duplicate"))
        nulls = " OR ".join(f"{c} IS NULL" for c in spec.primary_key)
        parts.append(f"SELECT 'pk_null', '{spec.name}', {_key(spec.primary_key)}, '' "
                     f"FROM {spec.name} WHERE {nulls}")
    return "\nUNION ALL\n".join(parts)


def _unique() -> str:
    return "\nUNION ALL\n".join(_dups(spec.name, cols, "unique_duplicate")
                                for spec in TABLES.values() for cols in spec.unique)


def _fk() -> str:
    parts = []
    for spec in TABLES.values():
        for fk in spec.foreign_keys:
            present = " AND ".join(f"c.{c} IS NOT NULL" for c in fk.columns)
            match = " AND ".join(f"p.{pc} = c.{cc}" for cc, pc in zip(fk.columns, fk.parent_columns))
            parts.append(
                f"SELECT 'fk_missing' AS rule, '{spec.name}' AS table_name, "
                f"{_key(spec.primary_key, 'c')} AS key, "
                f"'{fk.parent}:' || {_key(fk.columns, 'c')} AS detail FROM {spec.name} c "
                f"WHERE {present} AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE {match})")
    return "\nUNION ALL\n".join(parts)


def _check() -> str:
    parts = [f"SELECT 'check_failed' AS rule, '{spec.name}' AS table_name, "
             f"{_key(spec.primary_key)} AS key, '{chk.name}' AS detail "
             f"FROM {spec.name} WHERE NOT coalesce(({chk.predicate}), TRUE)"
             for spec in TABLES.values() for chk in spec.checks]
    return "\nUNION ALL\n".join(parts)


def _profile() -> str:
    parts = []
    for spec in TABLES.values():
        checks = [(c, "not_null", f"{c} IS NULL") for c in spec.not_null]
        checks += [(c, f"max_length_{n}", f"length({c}) > {n}") for c, n in spec.max_length.items()]
        for col, rule, cond in checks:
            parts.append(f"SELECT '{spec.name}' AS table_name, '{col}' AS column_name, "
                         f"'{rule}' AS rule, (SELECT count(*) FROM {spec.name} WHERE {cond}) "
                         f"AS violations")
    return "\nUNION ALL\n".join(parts)


def _domain() -> str:
    parts = []
    for spec in TABLES.values():
        for col, values in spec.domains.items():
            vals = ", ".join(f"'{v}'" for v in values)
            parts.append(f"SELECT 'domain' AS rule, '{spec.name}' AS table_name, "
                         f"{_key(spec.primary_key)} AS key, '{col}=' || {col} AS detail "
                         f"FROM {spec.name} "
                         f"WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})")
    return "\nUNION ALL\n".join(parts)


_WRONG_LINKS = ("[" + ", ".join(f"{c} IS NOT NULL" for c in LINK_COLUMNS) + "] IS DISTINCT FROM CASE role "
                + " ".join(f"WHEN '{role}' THEN {[c in links for c in LINK_COLUMNS]}" for role, links in ROLE_LINKS.items()) + " END")


def _table_rules() -> str:
    """Row rules and unique keys, a SELECT each, with the number of rows that a finding stands for."""
    out = []
    for spec in TABLES.values():
        key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in spec.primary_key) + ")"

        def bad(rule: str, detail: str, cond: str) -> None:
            out.append(f"SELECT '{rule}' AS rule, '{spec.name}' AS table_name, {key} AS key, {detail} AS detail, "
                       f"count(*) AS n_rows FROM {spec.name} WHERE {cond} GROUP BY ALL")
        bad("pk_null", "''", " OR ".join(f"{c} IS NULL" for c in spec.primary_key))
        for c in spec.checks:
            bad("check_failed", f"'{c.name}'", f"NOT coalesce({c.predicate}, TRUE)")
        for c, values in spec.domains.items():
            bad("domain", f"'{c}=' || {c}", f"{c} NOT IN ({', '.join(repr(v) for v in values)})")
        for c in spec.not_null:
            bad("not_null", f"'{c}'", f"{c} IS NULL")
        for c, n in spec.max_length.items():
            bad(f"max_length_{n}", f"'{c}'", f"length({c}) > {n}")
        if spec.name == "user_account":
            bad("role_link", "role", _WRONG_LINKS)
        for rule, cols in [("pk_duplicate", spec.primary_key), *[("unique_duplicate", u) for u in spec.unique]]:
            text = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
            out.append(f"SELECT '{rule}' AS rule, '{spec.name}' AS table_name, {text} AS key, '{','.join(cols)}' AS detail, "
                       f"count(*) AS n_rows FROM {spec.name} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} "
                       f"GROUP BY ALL HAVING count(*) > 1")
    return " UNION ALL ".join(out)


SQL = {
    "audit_table_rules": _table_rules(),
    "audit_pk": _pk(),
    "audit_unique": _unique(),
    "audit_fk": _fk(),
    "audit_check": _check(),
    "audit_not_null": _profile(),
    "audit_domain": _domain(),
    "audit_role_link": f"""
        SELECT 'role_link' AS rule, 'user_account' AS table_name, CAST(user_id AS VARCHAR) AS key, role AS detail
        FROM user_account WHERE {_WRONG_LINKS}""",
    "audit_recruiter_company": """
        SELECT 'recruiter_company' AS rule, 'job' AS table_name, CAST(j.job_id AS VARCHAR) AS key,
               'recruiter_company=' || CAST(r.company_id AS VARCHAR) AS detail
        FROM job j JOIN recruiter r ON r.recruiter_id = j.recruiter_id
        WHERE r.company_id <> j.company_id""",
    "audit_offer_gate": """
        SELECT 'offer_gate' AS rule, 'offer' AS table_name, CAST(o.offer_id AS VARCHAR) AS key,
               'status=' || a.status AS detail
        FROM offer o JOIN application a ON a.application_id = o.application_id
        WHERE a.status <> 'Selected'""",
    "audit_application_rules": f"""
        WITH r AS (SELECT application_id AS request_id, student_id, job_id FROM application),
        d AS ({decide_sql('r')})
        SELECT 'application_rules' AS rule, 'application' AS table_name,
               CAST(request_id AS VARCHAR) AS key, reasons_text AS detail
        FROM d WHERE NOT eligible""",
}
