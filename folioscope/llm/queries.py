"""Queries of the text problems and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from folioscope.llm import q_lookalikes, q_markup, q_mixing, q_packing, q_scans, q_subjects, q_survivors, q_truncation

_MODULES = [q_lookalikes, q_markup, q_truncation, q_scans, q_survivors, q_subjects, q_packing, q_mixing]
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
