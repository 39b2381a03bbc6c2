"""Queries of problem 3."""

from __future__ import annotations

from folioscope.llm import lookalikes
from folioscope.session import spread


def _units(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/units.parquet").select("unit_id", "content"))


def p3_found(spark, sf_dir):
    return lookalikes.same_look_pairs(_units(spark, sf_dir))


def p3_canonical(spark, sf_dir):
    return lookalikes.canonical_text(_units(spark, sf_dir), "unit_id", "content")


def p3_classes(spark, sf_dir):
    return lookalikes.same_look_members(_units(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_canonical": p3_canonical, "p3_classes": p3_classes}

# The SQL looks at each code point on its own, by numbers and ranges; it shares no expression with the operator.
# Code points of Greek and Cyrillic letters of a Latin letter's shape, and of that letter.
_SHAPED = (
    "913 65, 914 66, 917 69, 918 90, 919 72, 921 73, 922 75, 924 77, 925 78, 927 79, 929 80, 932 84, 933 89, 935 88, 959 111, "
    "1040 65, 1042 66, 1045 69, 1050 75, 1052 77, 1053 72, 1054 79, 1056 80, 1057 67, 1058 84, 1061 88, 1029 83, 1030 73, 1032 74, "
    "1072 97, 1077 101, 1086 111, 1088 112, 1089 99, 1091 121, 1093 120, 1109 115, 1110 105, 1112 106, 1211 104, 1281 100, 1307 113, 1309 119"
)
_CASES = " ".join(f"WHEN {a} THEN chr({b})" for a, b in (pair.split() for pair in _SHAPED.split(", ")))
_UNSEEN = "u IN (173, 847, 1564, 4447, 4448, 6068, 6069, 65279) OR u BETWEEN 6155 AND 6158 OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238 OR u BETWEEN 8288 AND 8303 OR u BETWEEN 65024 AND 65039"
_GAPS = "u IN (9, 160, 5760, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202"
_WIDE = "u BETWEEN 65281 AND 65374"
_LOOK = f"""SELECT i, any_value(content) AS content, trim(nfc_normalize(coalesce(string_agg(CASE WHEN {_UNSEEN} THEN '' WHEN {_GAPS} THEN ' ' WHEN {_WIDE} THEN chr(u - 65248)
 ELSE CASE u {_CASES} ELSE chr(u) END END, '' ORDER BY p), ''))) AS look
FROM (SELECT i, content, p, unicode(substring(content, p, 1)) AS u FROM (SELECT row_number() OVER () AS i, content FROM (SELECT DISTINCT content FROM units WHERE content <> '')), unnest(range(1, length(content) + 1)) AS r(p)) GROUP BY i"""
_LOOKS = f"looks AS ({_LOOK}), k AS (SELECT unit_id, content, look FROM units JOIN looks USING (content) WHERE look <> '')"
ORACLE = {
    "p3_found": f"""WITH {_LOOKS}, f AS (SELECT look, content, min(unit_id) AS first FROM k GROUP BY 1, 2)
SELECT DISTINCT least(k.unit_id, f.first) AS unit_id_a, greatest(k.unit_id, f.first) AS unit_id_b FROM k JOIN f ON k.look = f.look AND k.content <> f.content WHERE k.unit_id <> f.first""",
    "p3_canonical": f"WITH looks AS ({_LOOK}) SELECT unit_id, CASE WHEN content = '' THEN '' ELSE look END AS canonical FROM units LEFT JOIN looks USING (content)",
    "p3_classes": f"""WITH {_LOOKS}, n AS (SELECT look, count(DISTINCT content) AS forms, count(*) AS records, min(unit_id) AS class_id FROM k GROUP BY 1)
SELECT DISTINCT unit_id, class_id, (SELECT min(x.unit_id) FROM k x WHERE x.content = k.content) AS form_id, forms, records FROM k JOIN n USING (look) WHERE forms > 1""",
}
