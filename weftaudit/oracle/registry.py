"""All oracle SQL."""

from __future__ import annotations

from weftaudit.oracle import html_sql, more_sql, site_sql, text_sql

ORACLE = {**html_sql.ORACLE, **text_sql.ORACLE, **site_sql.ORACLE, **more_sql.ORACLE}
