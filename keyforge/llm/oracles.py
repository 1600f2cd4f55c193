"""DuckDB statements for the operators that SQL can express exactly."""

from __future__ import annotations

# The licence sentences and rules are written out again here, as SQL.
_LICENCES = r"""
WITH s AS (
  SELECT doc_id, list_transform(
           list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
             lambda x: regexp_matches(x, '(?i)licen[sc]|copyright|permission|warrant|redistribut|liable|spdx|all rights reserved')),
           lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')) AS xs
  FROM documents),
i AS (
  SELECT doc_id, list_transform(xs, lambda x: CASE
    WHEN regexp_matches(x, '^.{0,20}spdx license identifier ') THEN 'SpdxTag'
    WHEN regexp_matches(x, 'licensed under (the )?apache license version 2 0') THEN 'Apache2Ref'
    WHEN x = 'you may not use this file except in compliance with the license' THEN 'Apache2NotUse'
    WHEN starts_with(x, 'you may obtain a copy of the license at') THEN 'Apache2Copy'
    WHEN starts_with(x, 'unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis') THEN 'Apache2AsIs'
    WHEN x = 'see the license for the specific language governing permissions and limitations under the license' THEN 'Apache2See'
    WHEN regexp_matches(x, '(released|licensed|distributed|available) under the (terms of the )?mit license') THEN 'MitRef'
    WHEN starts_with(x, 'permission is hereby granted free of charge to any person obtaining a copy of this software') THEN 'MitGrant'
    WHEN starts_with(x, 'the above copyright notice and this permission notice shall be included in all copies') THEN 'MitNotice'
    WHEN starts_with(x, 'the software is provided as is without warranty of any kind') THEN 'AsIsUpper'
    WHEN regexp_matches(x, '^in no event shall the (authors|copyright holder)') THEN 'NoLiability'
    WHEN starts_with(x, 'redistribution and use in source and binary forms with or without modification are permitted') THEN 'BsdRedistribute'
    WHEN starts_with(x, 'redistributions of source code must retain the above copyright notice') THEN 'BsdSource'
    WHEN starts_with(x, 'redistributions in binary form must reproduce the above copyright notice') THEN 'BsdBinary'
    WHEN regexp_matches(x, '^neither the name of .* may be used to endorse or promote products') THEN 'BsdNoEndorse'
    WHEN regexp_matches(x, 'licensed under the (terms of the )?gnu general public license (version|v) ?3') THEN 'GplRef3'
    WHEN regexp_matches(x, 'licensed under the (terms of the )?gnu general public license (version|v) ?2') THEN 'GplRef2'
    WHEN regexp_matches(x, '^this program is free software you can redistribute it .* version 3 of the license') THEN 'GplFree3'
    WHEN regexp_matches(x, '^this program is free software you can redistribute it .* version 2 of the license') THEN 'GplFree2'
    WHEN starts_with(x, 'this program is distributed in the hope that it will be useful but without any warranty') THEN 'GplHope'
    WHEN starts_with(x, 'you should have received a copy of the gnu general public license') THEN 'GplCopy'
    WHEN regexp_matches(x, 'licensed under (a )?(cc|creative commons) (by nc|attribution noncommercial) 4 0') THEN 'CcByNc4Ref'
    WHEN regexp_matches(x, 'licensed under (a )?(cc|creative commons) (by sa|attribution sharealike) 4 0') THEN 'CcBySa4Ref'
    WHEN regexp_matches(x, 'licensed under (a )?(cc|creative commons) (by|attribution) 4 0') THEN 'CcBy4Ref'
    WHEN contains(x, 'all rights reserved') THEN 'AllRights'
    WHEN starts_with(x, 'copyright ') THEN 'Copyright'
    ELSE 'unknown' END) AS ids
  FROM s),
m AS (
  SELECT doc_id, ids, regexp_extract_all(CASE WHEN len(ids) > 0 THEN array_to_string(ids, ';') || ';' ELSE '' END,
    'Apache2Ref;Apache2NotUse;Apache2Copy;Apache2AsIs;Apache2See;|Apache2Ref;Apache2NotUse;Apache2Copy;|MitGrant;MitNotice;AsIsUpper;NoLiability;|MitGrant;MitNotice;|BsdRedistribute;BsdSource;BsdBinary;BsdNoEndorse;|BsdRedistribute;BsdSource;BsdBinary;|GplFree3;GplHope;GplCopy;|GplFree2;GplHope;GplCopy;|Apache2Ref;|MitRef;|GplRef3;|GplRef2;|CcByNc4Ref;|CcBySa4Ref;|CcBy4Ref;|SpdxTag;|AllRights;') AS ms
  FROM i),
n AS (
  SELECT doc_id, ids, list_transform(ms, lambda x: CASE
    WHEN starts_with(x, 'Apache2') THEN 'Apache-2.0' WHEN starts_with(x, 'Mit') THEN 'MIT'
    WHEN x = 'BsdRedistribute;BsdSource;BsdBinary;BsdNoEndorse;' THEN 'BSD-3-Clause' WHEN starts_with(x, 'Bsd') THEN 'BSD-2-Clause'
    WHEN starts_with(x, 'GplFree3') THEN 'GPL-3.0-or-later' WHEN starts_with(x, 'GplFree2') THEN 'GPL-2.0-or-later'
    WHEN x = 'GplRef3;' THEN 'GPL-3.0-only' WHEN x = 'GplRef2;' THEN 'GPL-2.0-only'
    WHEN x = 'CcByNc4Ref;' THEN 'CC-BY-NC-4.0' WHEN x = 'CcBySa4Ref;' THEN 'CC-BY-SA-4.0' WHEN x = 'CcBy4Ref;' THEN 'CC-BY-4.0'
    WHEN x = 'SpdxTag;' THEN 'SPDX' ELSE 'proprietary' END) AS names
  FROM m)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ';'), '') AS sentence_ids, len(names)::BIGINT AS n_matches,
       coalesce(array_to_string(list_transform(list_filter(list_zip(names, range(len(names))), lambda p: list_position(names, p[1]) = p[2] + 1), lambda p: p[1]), ','), '') AS licences,
       len(list_filter(ids, lambda x: x = 'unknown'))::BIGINT AS n_unknown
FROM n
"""

# Targets by resharing round after round; thresholds by sorting whole sources.
_MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((sid - 1) % 3 + 1)::INT) AS w, (2 * source_size)::DOUBLE AS cap, 1.5 * (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
rounds AS (
  SELECT 0 AS r, sid, false AS capped FROM w
  UNION ALL
  SELECT r + 1, sid, now FROM (
    SELECT r, sid, capped, capped OR cap <= (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (sum(w.w) FILTER (NOT capped) OVER ()) * w.w AS now,
           sum(capped::INT) OVER () AS n0
    FROM rounds JOIN w USING (sid))
  WHERE r < 100
  QUALIFY sum(now::INT) OVER () > n0),
last AS (SELECT sid, capped FROM rounds WHERE r = (SELECT max(r) FROM rounds)),
ordered AS (
  SELECT w.*, capped, total - coalesce(sum(cap) FILTER (capped) OVER (ORDER BY capped DESC, cap / w.w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS remaining,
         sum(w.w) FILTER (NOT capped) OVER () AS free
  FROM w JOIN last USING (sid)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE remaining / free * w END AS target
  FROM ordered),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
cells AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
upto AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM cells),
taken AS (
  SELECT u.source, u.h, CASE WHEN upto <= rest THEN 1 WHEN upto - n <= rest AND rest - (upto - n) > n / 2 THEN 1 ELSE 0 END AS more
  FROM upto u JOIN (SELECT source, target - epochs * source_size AS rest FROM e) r ON u.source IS NOT DISTINCT FROM r.source
  WHERE rest > 0)
SELECT d.doc_id, d.size, e.source_size, e.target, (d.size * (e.epochs + coalesce(k.more, 0)))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN taken k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

# Every pair that shares a shingle, then the least id that links reach.
_NEARDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                      WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END AS shingles
  FROM w),
one AS (SELECT min(doc_id) AS rep, list_sort(shingles) AS k, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY ALL),
named AS (SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, o.rep FROM sets s LEFT JOIN one o ON list_sort(s.shingles) = o.k),
x AS (SELECT rep, n, unnest(k) AS g FROM one),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM one UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n_shingles, coalesce(l.component_id, n.doc_id) AS component_id, n.doc_id = coalesce(l.component_id, n.doc_id) AS kept
FROM named n LEFT JOIN least_id l ON n.rep = l.a
"""

# The damage by a CRC-32 whose table is built by its rule; the program as a
# recursion over rows that keeps, per state, the cheapest and then least letters.
_REPAIR = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name FROM conversations),
hashed AS (SELECT raw.* EXCLUDE (name), xor(list_reduce(name, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS harm FROM raw, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
                CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt),
seen AS (SELECT *, regexp_matches(text, '^[\x20\x09-\x0D]*$') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS twice,
                NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
marked AS (SELECT *, blank OR twice AS must_go, (short AND NOT blank AND NOT twice) AS truncated,
                  (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM seen),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                  count(*) FILTER (twice AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
           FROM marked GROUP BY conv_id),
ways(conv_id, k, state, cost, audit, said) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM conversations
  UNION ALL
  (WITH one AS (SELECT *, CASE state WHEN 2 THEN 'assistant' ELSE 'user' END AS due, CASE state WHEN 2 THEN 3 ELSE 2 END AS after FROM ways),
   two AS (SELECT *, CASE after WHEN 2 THEN 'assistant' ELSE 'user' END AS due2, CASE after WHEN 2 THEN 3 ELSE 2 END AS after2 FROM one),
   with_inserts AS (SELECT conv_id, k, u.* FROM (SELECT conv_id, k, unnest([
       {'state': state, 'cost': cost, 'audit': audit, 'said': said},
       {'state': after, 'cost': cost + 3, 'audit': audit || 'I', 'said': said || due || ':' || chr(10)},
       {'state': after2, 'cost': cost + 6, 'audit': audit || 'II', 'said': said || due || ':' || chr(10) || due2 || ':' || chr(10)}]) AS u FROM two)),
   ready AS (SELECT w.*, m.role, m.text, m.must_go, CASE WHEN m.truncated THEN 3 ELSE 0 END AS more,
                    CASE w.state WHEN 2 THEN 'assistant' ELSE 'user' END AS due, CASE w.state WHEN 2 THEN 3 ELSE 2 END AS after
             FROM with_inserts w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1),
   edits AS (
     SELECT conv_id, k + 1 AS k, state, cost + 4 AS cost, audit || 'D' AS audit, said FROM ready
     UNION ALL SELECT conv_id, k + 1, after, cost + 3 + more, audit || 'R', said || due || ':' || text || chr(10) FROM ready WHERE NOT must_go
     UNION ALL SELECT conv_id, k + 1, CASE WHEN left(role, 1) = 's' THEN 1 ELSE after END, cost + more, audit || 'K', said || role || ':' || text || chr(10)
       FROM ready WHERE NOT must_go AND (left(role, 1) = left(due, 1) OR (left(role, 1) = 's' AND state = 0)))
   SELECT conv_id, k, state, cost, audit, said FROM edits QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1)),
done AS (SELECT w.* FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = coalesce(c.n, 0)),
ends AS (
  SELECT conv_id, state, cost, audit, said FROM done
  UNION ALL SELECT conv_id, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', said || CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) FROM done
  UNION ALL SELECT conv_id, CASE state WHEN 2 THEN 2 ELSE 3 END, cost + 6, audit || 'II', said || CASE state WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) FROM done),
best AS (SELECT * FROM ends WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit,
       sha256(CASE WHEN said = '' THEN '' ELSE left(said, length(said) - 1) END) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLE = {"op1_license_scan": _LICENCES, "op6_source_mixing": _MIXING, "op10_minhash_neardup": _NEARDUP, "op13_conversation_repair": _REPAIR}
