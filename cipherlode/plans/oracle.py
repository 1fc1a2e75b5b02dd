"""The queries in SQL, for comparison with another engine. Written from the rules, line by line where the scanner works on whole texts."""

from __future__ import annotations

from cipherlode import rules
from cipherlode.sources.corpus import BINARY_FILES_SQL, BINARY_HITS_SQL, CODE_FILES_SQL, FOLDERS, OBSERVED_SQL, SYMBOL_ROWS_SQL, TEXT_FILES_SQL, _sql_list


def _text(v) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") as t({names})"


def _case(name: str, cases, default: str, fn: str = "upper") -> str:
    out = " ".join("when " + " or ".join(f"contains({fn}({name}), {_text(p)})" for p in parts) + f" then {_text(value)}" for parts, value in cases)
    return f"case {out} else {default} end"


OBS = f"obs as ({OBSERVED_SQL})"
CODE = f"code as ({CODE_FILES_SQL}), lines as (select file_id, path, repo_id, unnest(string_split(content, chr(10))) as txt, generate_subscripts(string_split(content, chr(10)), 1)::int as line from code)"
RISK = f"risks as (select algorithm, base::double as base, pqc::double as pqc, status from {_values(rules.RISKS, 'algorithm, base, pqc, status')})"
SCORED = f"""{OBS}, {RISK}, plain as (select o.*, coalesce(r.base, 50.0::double) as base, coalesce(r.pqc, 0.0::double) as pqc, coalesce(r.status, 'unknown') as status, coalesce(r.base, 50.0::double) * 0.7::double + coalesce(r.pqc, 0.0::double) * 0.3::double as r0 from obs o left join risks r using (algorithm)),
scored as (select *, least(100.0::double, case when key_length is not null and key_length <> 0 and key_length < 128 then r0 + 15.0::double when key_length > 256 then r0 - 5.0::double else r0 end) as risk from plain)"""
LEVEL = "case when risk >= 80 then 'critical' when risk >= 60 then 'high' when risk >= 40 then 'medium' else 'low' end"

_parts = lambda table: [(parts, ",".join(v) if isinstance(v, tuple) else v) for v, parts in table]
PRIMITIVE = _case("algorithm", _parts(rules.PRIMITIVE_TYPES), f"'{rules.PRIMITIVE_DEFAULT}'", "lower")
FUNCTIONS = _case("algorithm", _parts(rules.FUNCTIONS), f"'{','.join(rules.FUNCTIONS_DEFAULT)}'", "lower")
FAMILY = _case("algorithm", _parts(rules.FAMILIES), "algorithm")
CATEGORY = _case("algorithm", _parts(rules.CATEGORIES), f"'{rules.UNKNOWN}'")
STATUS = _case("algorithm", _parts(rules.PQC_STATUSES), f"'{rules.UNKNOWN}'")


def _jca(arg: str) -> str:
    out = []
    for api, test, algorithm, _, confidence in rules.GET_INSTANCE_RULES:
        kind, _, value = test.partition(":")
        head, _, rest = value.partition("+")
        holds = {"has": f"contains(upper({arg}), '{value}')", "starts": f"starts_with(upper({arg}), '{head}') and contains(upper({arg}), '{rest}')", "is": f"upper({arg}) = '{value}'", "any": "true"}[kind]
        out.append(f"when api = '{api}' and {holds} then {{'a': {_text(algorithm)}, 'c': {confidence}::double}}")
    return "case " + " ".join(out) + " else {'a': 'generic-crypto', 'c': 0.6::double} end"


def _rule_table(name: str, table, phase: int, detector: str, start: int = 0) -> str:
    rows = [(phase, start + i, "(?i)" + rx, a, a, c, detector) for i, (rx, a, _, c) in enumerate(table)]
    return f"{name} as (select phase, ord, rx, name, algorithm, confidence::double as confidence, detector from {_values(rows, 'phase, ord, rx, name, algorithm, confidence, detector')})"


KEY_RX = rules.OPERATIONS[0][0]
_calls = [(4, i, rf"(?i)\b{n}\s*\(", n, a, c, "source_symbol") for i, (n, a, _, c) in enumerate(rules.CALLS)]
_consts = rf"""consts as (select file_id, regexp_extract_all(content, {_text('(?i)' + rules.STRING_CONSTANT)}, 1) as ks, regexp_extract_all(content, {_text('(?i)' + rules.STRING_CONSTANT)}, 2) as vs from code)"""


def _resolve(raw: str) -> str:
    last = f"trim(string_split({raw}, '.')[-1])"
    known = lambda t: f"vs[list_position(ks, {t})]"
    return f"""case when regexp_full_match({raw}, '"[^"]+"') then trim({raw}, '"') when list_contains(ks, {raw}) then {known(raw)} when list_contains(ks, {last}) then {known(last)} else '' end"""


SCAN = rf"""{CODE}, {_consts},
{_rule_table("r1", rules.IMPORTS, 1, "java_import_signal")}, {_rule_table("r2", rules.OPERATIONS[1:], 2, "java_jca_resolver", 2)}, {_rule_table("r3", rules.PATTERNS, 3, "source_pattern")},
r4 as (select phase, ord, rx, name, algorithm, confidence::double as confidence, detector from {_values(_calls, "phase, ord, rx, name, algorithm, confidence, detector")}),
jraw as (select file_id, line, unnest(regexp_extract_all(txt, {_text('(?i)' + rules.GET_INSTANCE)}, 1)) as api, trim(unnest(regexp_extract_all(txt, {_text('(?i)' + rules.GET_INSTANCE)}, 2))) as raw from lines where ends_with(path, '.java')),
jcls as (select file_id, line, {_jca("arg")} as x from (select j.*, {_resolve("raw")} as arg from jraw j join consts using (file_id))),
kraw as (select file_id, line, trim(unnest(regexp_extract_all(txt, {_text('(?i)' + KEY_RX)}, 1))) as raw from lines where ends_with(path, '.java')),
kcls as (select file_id, line, case when contains(arg, 'AES') then {{'a': 'AES', 'c': 0.9::double}} when contains(arg, 'RSA') then {{'a': 'RSA', 'c': 0.9::double}} when contains(arg, 'CHACHA') then {{'a': 'ChaCha20', 'c': 0.9::double}} when arg <> '' then {{'a': arg, 'c': 0.82::double}} else {{'a': 'generic-symmetric-key', 'c': 0.7::double}} end as x
  from (select k.*, upper({_resolve("raw")}) as arg from kraw k join consts using (file_id))),
alls as (
  select file_id, line, txt, phase, ord, name, algorithm, confidence, detector from lines join r1 on regexp_matches(txt, rx) where ends_with(path, '.java')
  union all select file_id, line, null, 2, 0, x.a, x.a, x.c, 'java_jca_resolver' from jcls
  union all select file_id, line, null, 2, 1, x.a, x.a, x.c, 'java_jca_resolver' from kcls
  union all select file_id, line, txt, phase, ord, name, algorithm, confidence, detector from lines join r2 on regexp_matches(txt, rx) where ends_with(path, '.java')
  union all select file_id, line, txt, phase, ord, name, algorithm, confidence, detector from lines join r3 on regexp_matches(txt, rx)
  union all select file_id, line, txt, phase, ord, name, algorithm, confidence, detector from lines join r4 on regexp_matches(txt, rx)),
ranked as (select *, row_number() over (partition by file_id, line, name order by phase, ord) as k from alls),
spec as (select distinct file_id, line from ranked where phase = 2 and k = 1 and algorithm <> 'generic-cipher'),
kept as (select r.* from ranked r left join spec s on r.file_id = s.file_id and r.line = s.line
  where not (phase = 3 and algorithm = 'ECC' and contains(lower(txt), 'ec.') and regexp_matches(lower(txt), 'select | from | join | where |insert |update '))
  and not (phase = 3 and algorithm = 'generic-cipher' and contains(txt, 'Cipher.getInstance') and (s.file_id is not null or regexp_matches(upper(txt), 'AES/|RSA/|CHACHA20|DES/')))),
hits as (select h.*, l.txt as snippet, l.path, l.repo_id from (select * exclude (txt, k) from (select *, row_number() over (partition by file_id, line, name order by phase, ord) as k2 from kept) where k2 = 1) h join lines l using (file_id, line))"""

ASSETS = f"{SCAN}, assets as (select file_id, path, repo_id, algorithm, count(*) as occurrences, max(confidence) as confidence, list(distinct detector) as detectors, count(distinct line) as evidence_count from hits group by all)"

VALID = """v0 as (select *, least(1.0::double, greatest(0.1::double, confidence)) as base, {CATEGORY} as category, {FAMILY} as family, {STATUS} as pqc_status from {SRC}),
v1 as (select *,
  case when category in ('hash_function', 'rng') then 'not_applicable' when key_length is null then 'unknown' else 'known' end as key_length_state,
  case when category in ('hash_function', 'rng', 'mac', 'key_exchange', 'asymmetric_cryptography') then 'not_applicable' when mode is null then 'unknown' when category = 'symmetric_encryption' and upper(mode) not in ('CBC', 'GCM', 'CTR', 'ECB', 'CCM') then 'bad' when contains(upper(algorithm), 'RSA') then 'rsa' else 'known' end as ms,
  case when category in ('hash_function', 'rng', 'mac', 'key_exchange') then 'not_applicable' when category = 'symmetric_encryption' and upper(mode) in ('GCM', 'CCM', 'CTR') then 'aead' when padding is null then 'unknown' else 'known' end as ps from v0),
v2 as (select *, case ms when 'bad' then 'unknown' when 'rsa' then 'not_applicable' else ms end as mode_state, case ps when 'aead' then 'not_applicable' else ps end as padding_state,
  list_filter([case when category = 'unknown' then 'unknown_category' end, case when category = 'asymmetric_cryptography' and mode is not null then 'mode_removed_for_asymmetric' end, case when ms = 'bad' then 'invalid_mode_for_symmetric' end,
   case when ps = 'aead' and padding is not null then 'padding_removed_for_aead_or_stream_mode' end, case when ms = 'rsa' then 'cross_algorithm_contamination_mode_removed' end], lambda x: x is not null) as issues from v1),
v3 as (select *, case key_length_state when 'known' then base when 'unknown' then 0.35::double else 1.0::double end as kc, case when ms = 'bad' then 0.3::double when mode_state = 'known' then base when mode_state = 'unknown' then 0.35::double else 1.0::double end as mc, case padding_state when 'known' then base when 'unknown' then 0.35::double else 1.0::double end as pc,
  (key_length_state <> 'not_applicable')::int + (mode_state <> 'not_applicable')::int + (padding_state <> 'not_applicable')::int as applicable, (key_length_state = 'unknown')::int + (mode_state = 'unknown')::int + (padding_state = 'unknown')::int as unknowns from v2)""".replace("{CATEGORY}", CATEGORY).replace("{FAMILY}", FAMILY).replace("{STATUS}", STATUS)

DECIDE = """d0 as (select *, len(issues)::int as issue_count, (base + 0.95::double + kc + mc + pc + base) / 6.0::double as favg, case when applicable = 0 then 0.0::double else unknowns::double / applicable end as unknown_ratio,
  list_contains(issues, 'invalid_mode_for_symmetric') or list_contains(issues, 'cross_algorithm_contamination_mode_removed') as hard, list_contains(issues, 'unknown_category') as unk, list_contains(issues, 'mode_removed_for_asymmetric') as asy, list_contains(issues, 'padding_removed_for_aead_or_stream_mode') as pad from v3),
d1 as (select *, case when hard then 'high' when unk or asy then 'medium' else 'low' end as max_severity, case when hard then 'drop' when unk then 'require_review' when asy or pad then 'keep_with_penalty' else 'keep' end as a0,
  (list_contains(issues, 'invalid_mode_for_symmetric')::int * 35 + list_contains(issues, 'cross_algorithm_contamination_mode_removed')::int * 35 + unk::int * 15 + asy::int * 15 + pad::int * 5)::double as severity_penalty from d0),
d2 as (select *, least(100.0::double, greatest(0.0::double, 100.0::double * (0.45::double * base + 0.25::double * favg + 0.15::double * (1.0::double - unknown_ratio) + 0.15::double * (case when evidence_count >= 2 then 1.0::double when evidence_count = 1 then 0.7::double else 0.0::double end)) - severity_penalty - 2.0::double * issue_count)) as q0 from d1),
d3 as (select *, round_even(q0, 2) as quality_score, evidence_count >= 1 and base >= 0.85 and regexp_matches(upper(algorithm), 'TLS|SSL|RNG') as auto from d2),
d4 as (select *, case when auto then ['auto_include_tls_high_confidence'] when a0 = 'drop' then ['drop_action_policy'] when a0 = 'require_review' then ['requires_review'] else list_filter([case when evidence_count < 1 then 'insufficient_evidence' end, case when base < 0.55::double then 'low_confidence' end, case when favg < 0.5::double then 'low_field_confidence' end,
  case when unknown_ratio > 0.5 then 'high_unknown_ratio' end, case when quality_score < 60 then 'quality_below_threshold' end], lambda x: x is not null) end as reasons from d3),
dec as (select *, auto or len(reasons) = 0 as include, case when auto then 'keep_with_penalty' else a0 end as final_action, case when quality_score >= 80 then 'high_quality' when quality_score >= 60 then 'medium_quality' else 'low_quality' end as quality_tier,
  case when auto or len(reasons) = 0 then 'training' when a0 = 'require_review' then 'review' when a0 = 'drop' then 'policy_drop' else 'quality_reject' end as split from d4)"""

LABELLED = f"with {OBS}, {VALID.replace('{SRC}', 'obs')}, {DECIDE}"
FILES_LABELLED = f"with {ASSETS}, src as (select *, null::int as key_length, null::varchar as mode, null::varchar as padding from assets), {VALID.replace('{SRC}', 'src')}, {DECIDE}"
PRICES = "p as (select user_id as ticker, ts, event_id, value as close, value + 1.0::double as high, value - 1.0::double as low from events)"
_week = "over (partition by ticker order by ts, event_id rows between 6 preceding and current row)"
_name = lambda expr: f"with {OBS} select ref, algorithm, {expr} as value from obs"
_paths = "paths as (select (['src', 'src/build', 'lib', 'vendor/x', 'SRC', 'm4', 'node_modules/a'])[(p_partkey % 7 + 1)::int] || '/F' || (p_partkey % 300) || (['.py', '.java', '.txt', '.c', '.ts'])[(p_partkey % 5 + 1)::int] as path from part)"
_out = "regexp_matches(lower(path), '[.]git|node_modules|target|build|dist|vendor|__pycache__')"
_counts = "count(*) as assets_total, sum((split = 'training')::int)::bigint as training, sum((split = 'review')::int)::bigint as review, sum((split = 'policy_drop')::int)::bigint as policy_drop, sum((split = 'quality_reject')::int)::bigint as quality_reject, sum((split in ('policy_drop', 'quality_reject'))::int)::bigint as dropped"
_rec = "case when risk >= 80 then " + " ".join([_text(rules.RECOMMENDATIONS[0][1]), "when risk >= 50 then", _text(rules.RECOMMENDATIONS[1][1]), "when risk >= 25 then", _text(rules.RECOMMENDATIONS[2][1]), "else", _text(rules.RECOMMENDATIONS[3][1]), "end"])

# the repository with binaries: as above, over nine tenths of the texts, and what the binaries hold


def _bucket(holds: str) -> str:
    item = f"concat_ws('|', algorithm, printf('%.2f', risk), {_rec}, case status when 'legacy' then {_text(rules.MITIGATIONS['legacy'])} when 'broken' then {_text(rules.MITIGATIONS['broken'])} end)"
    return f"coalesce(string_agg({item}, ';' order by algorithm) filter (where {holds}), '')"


_known = f"(name in ({', '.join(_text(n) for n, *_ in rules.SYMBOLS)}) or (kind <> 'symbol' and ({' or '.join(f'starts_with(name, {_text(n)})' for n, *_ in rules.PREFIXES)})))"
SYMBOLS = f"""seen as ({SYMBOL_ROWS_SQL}), firsts as (select file_id, case kind when 'library' then 'library' else 'name' end as kind, name, min(place) as place from seen where kind = 'library' or {_known} group by 1, 2, 3),
placed as (select *, row_number() over (partition by file_id, kind order by place, name) as k from firsts), names as (select * from placed where k <= case kind when 'library' then 40 else 120 end)"""
R_SCAN = f"{SCAN.replace(CODE_FILES_SQL, TEXT_FILES_SQL)}, bfiles as ({BINARY_FILES_SQL}), bhits as ({BINARY_HITS_SQL})"
R_ASSETS = f"""{R_SCAN}, assets as (
  select file_id, path, algorithm, 'source-code' as source, max(confidence) as confidence, count(distinct line) as evidence_count from hits group by all
  union all select file_id, path, algorithm, 'binary', max(confidence), count(*) from bhits group by all)"""
R_LABELLED = f"with {R_ASSETS}, src as (select *, null::int as key_length, null::varchar as mode, null::varchar as padding from assets), {VALID.replace('{SRC}', 'src')}, {DECIDE}"
_plain = "coalesce(base, 50.0::double) * 0.7::double + coalesce(pqc, 0.0::double) * 0.3::double"
_synonyms = "regexp_replace(upper(x), '^[ \\t]+|[ \\t]+$', '', 'g')"
for _old, _new in rules.SYNONYMS:
    _synonyms = f"replace({_synonyms}, {_text(_old)}, {_text(_new)})"

SQL = {
    "e03_scan_files": f"with {R_SCAN} select file_id::varchar as file_id, detector, name, algorithm, line, confidence from hits union all select file_id::varchar, detector, name, algorithm, 0, confidence from bhits",
    "c24_binary_prompts": f"with {SYMBOLS} select file_id, 'Binary file: S' || file_id || '.dll' || chr(10) || 'Detected libraries: ' || coalesce(string_agg(name, ', ' order by k) filter (where kind = 'library'), 'none') || chr(10) || 'Detected symbol names:' || chr(10) || coalesce(string_agg(name, ', ' order by k) filter (where kind = 'name'), 'none') as snippet from names group by file_id",
    "o05_names": f"with {SYMBOLS} select file_id, kind, (k - 1)::int as place, name as value from names",
    "t07_failures": f"with b as ({BINARY_FILES_SQL}) select path as file, case kind when 3 then 'no PE header' else 'unreadable' end as error from b where kind in (3, 5)",
    "k07_batch_summary": f"{R_LABELLED} select source, {_counts} from dec group by source",
    "a04_report": f"""with {R_ASSETS}, {RISK}, s as (select a.*, status, {_plain} as risk, coalesce(pqc, 0.0) > 50 as ready from assets a left join risks using (algorithm))
      select file_id::varchar as file_id, source as target_type, count(*) as total_crypto_components, sum(ready::int)::bigint as pqc_ready, sum((not ready)::int)::bigint as not_pqc_ready, least(100.0, avg(risk)) as overall_risk_score, round_even(avg(risk), 2) as average_risk,
      string_agg(algorithm, ',' order by algorithm) as names, {_bucket("risk >= 80")} as critical_issues, {_bucket("risk >= 60 and risk < 80")} as high_priority, {_bucket("risk >= 40 and risk < 60")} as medium_priority, {_bucket("risk < 40")} as low_priority from s group by file_id, source""",
    "a02_file_names": f"""with {R_SCAN}, u as (select file_id, algorithm, phase * 100000000::bigint + ord * 1000000 + line as o from hits union all select file_id, algorithm, phase * 100000000::bigint + ord * 1000000 + place from bhits),
      one as (select file_id, algorithm, count(*) as n, min(o) as o from u group by 1, 2)
      select file_id::varchar as file_id, sum(n)::bigint as total_crypto_functions, count(*) as unique_algorithms, string_agg(algorithm, ',' order by o) as algorithms, case when max(kind) in (0, 1) then 'OpenSSL' else '' end as libraries from one left join bfiles using (file_id) group by file_id""",
    "a03_summary_names": f"with {ASSETS}, {RISK}, s as (select file_id, algorithm, {_plain} as risk, coalesce(pqc, 0.0) as pqc from assets left join risks using (algorithm)) select file_id, count(*) as total_algorithms, sum((pqc > 50)::int)::bigint as pqc_compliant, sum((pqc <= 50)::int)::bigint as legacy_algorithms, round_even(avg(risk), 2) as average_risk, string_agg(algorithm, ',' order by algorithm) as names from s group by file_id",
    "a24_totals": f"with {SCORED} select count(*) as total_algorithms, sum((pqc > 50)::int)::bigint as pqc_compliant, sum((pqc <= 50)::int)::bigint as legacy_algorithms, round_even(avg(risk), 2) as average_risk, least(100.0, avg(risk)) as risk_score from scored",
    "f11_training_records": f"{LABELLED} select ref, algorithm, quality_tier from dec where include",
    "f15_severity_filter": f"{LABELLED} select ref, max_severity from dec where max_severity <> 'low'",
    "f16_tier_filter": f"{LABELLED} select ref, quality_tier from dec where quality_tier = 'high_quality'",
    "o06_first_evidence": f"with {SCAN}, e as (select file_id, algorithm, line, min(phase * 1000000 + ord * 1000) as o from hits group by 1, 2, 3), k as (select *, row_number() over (partition by file_id, algorithm order by o, line) - 1 as place from e) select place::int as place, count(*) as n, sum(line)::bigint as lines from k where place < 3 group by 1",
    "c12_quality_scores": f"{LABELLED} select ref, quality_score, quality_tier from dec",
    "c25_target_types": f"with t as (select 'TEXT' as file_type from part where p_partkey % 10 <> 7 union all select ['ELF', 'ELF', 'PE', 'PE', 'BINARY', 'UNKNOWN'][((p_partkey // 10) % 6 + 1)::int] from part where p_partkey % 10 = 7) select file_type, case when file_type in ('ELF', 'PE') then 'binary' else 'source-code' end as target_type, count(*) as n from t group by 1, 2",
    "f22_algorithm_risk": f"with {SCORED} select ref, round_even(risk, 1) as risk from scored",
    "k09_asset_lines": f"with {OBS}, {RISK}, s as (select o.*, {_plain} as risk, coalesce(pqc, 0.0) > 50 as safe from obs o left join risks r using (algorithm)) select concat_ws(',', algorithm, {PRIMITIVE}, coalesce(nullif(key_length, 0)::varchar, 'N/A'), case when safe then 'True' else 'False' end, printf('%.1f', risk), {LEVEL}) as value from s",
    "s10_decode_all": "select doc_id, length(t)::int as chars, md5(t) as md5 from (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from documents)",
    "f20_label_rows": f"{FILES_LABELLED} select substr(sha256(path || '|' || algorithm), 1, 16) as ref, algorithm, family, category, key_length_state, mode_state, padding_state, pqc_status, base as label_confidence, len(issues) = 0 as is_valid, issue_count from dec",
    "j12_upsert": f"""with {ASSETS}, {RISK}, m as (select file_id, content as t from code where length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 50),
      f as (select file_id, regexp_matches(t, '(?i)rsa') as rsa, regexp_matches(t, '(?i)aes') as aes, regexp_matches(t, '(?i)sha-?256') as s2, regexp_matches(t, '(?i)sha-?512') as s5, regexp_matches(t, '(?i)md5') as md, regexp_matches(t, '(?i)kyber|ml-kem') as ky, regexp_matches(t, '(?i)dilithium|ml-dsa') as di, regexp_matches(t, '(?i)[0-9]{{3,4}}(bit|-bit)') as kb, regexp_matches(t, '(?i)gcm|cbc|ecb|ctr') as mo from m),
      r as (select file_id, case when di then 'Dilithium/ML-DSA' when ky then 'Kyber/ML-KEM' when md then 'MD5' when s5 then 'SHA-512' when s2 then 'SHA-256' when aes then 'AES' when rsa then 'RSA' else 'unknown' end as algorithm, case when mo then 0.6 when kb then 0.7 when di or ky then 0.9 when md or s5 or s2 then 0.8 when aes or rsa then 0.7 else 0.3 end::double as c, case when mo then 'GCM/CBC/ECB/CTR' end as mode, ky or di as safe from f),
      a as (select file_id, algorithm, confidence, coalesce(pqc, 0.0) > 50 as safe from assets left join risks using (algorithm))
      select coalesce(a.file_id, r.file_id) as file_id, coalesce(a.algorithm, r.algorithm) as algorithm, greatest(a.confidence, r.c) as confidence, r.mode, coalesce(a.safe, false) or coalesce(r.safe, false) as is_pqc_safe, case when a.file_id is null then 'source-code' else 'static' end as source from a full join r on a.file_id = r.file_id and a.algorithm = r.algorithm""",
    "x01_scan_hits": f"with {SCAN} select file_id, phase, detector, name, algorithm, line, confidence from hits",
    "x02_call_hits": f"with {CODE}, r as (select * from {_values([(n, a) for n, a, _, _ in rules.CALLS], 'name, algorithm')}), m as (select line, lower(unnest(regexp_extract_all(txt, '(\\w+)\\s*\\(', 1))) as tok from lines) select name, algorithm, count(*) as n, sum(line)::bigint as lines from m join r on tok = lower(name) group by all",
    "x03_string_constants": f"with {CODE}, {_consts} select distinct file_id, unnest(ks) as name, unnest(vs) as value from consts",
    "x04_jca_calls": f"with {SCAN} select j.file_id, j.line, x.a as algorithm, p.primitive, x.c as confidence from jcls j join (select distinct * from {_values([(a, k, c) for _, _, a, k, c in rules.GET_INSTANCE_RULES], 'algorithm, primitive, confidence')}) p on p.algorithm = x.a and p.confidence::double = x.c",
    "x06_java_operations": f"with {SCAN} select file_id, line, x.a as algorithm, 'block-cipher' as primitive, x.c as confidence from kcls union all select file_id, line, o.algorithm, o.primitive, o.confidence::double from lines join {_values([('(?i)' + rx, a, k, c) for rx, a, k, c in rules.OPERATIONS[1:]], 'rx, algorithm, primitive, confidence').replace('as t', 'as o')} on regexp_matches(txt, o.rx) where ends_with(path, '.java')",
    "x07_java_imports": f"with {CODE}, {_rule_table('r1', rules.IMPORTS, 1, 'x')} select file_id, line, algorithm, confidence from lines join r1 on regexp_matches(txt, rx) where ends_with(path, '.java')",
    "x08_match_lines": "with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null), m as (select doc_id, line, len(regexp_extract_all(t, '[0-9]{3}')) as k from l) select doc_id, sum(k)::int as n, sum(k * line)::bigint as line_sum from m group by doc_id",
    "x09_context": f"with {SCAN}, nb as (select h.file_id, h.phase, h.name, h.algorithm, h.line, trim(h.snippet) as snippet, string_agg(case when l.line < h.line then l.txt end, chr(10) order by l.line) as b, string_agg(case when l.line > h.line then l.txt end, chr(10) order by l.line) as a from hits h join lines l on l.file_id = h.file_id and abs(l.line - h.line) <= 2 group by all) select file_id, phase, name, algorithm, line, snippet, trim(coalesce(b, ''), ' ' || chr(10)) as context_before, trim(coalesce(a, ''), ' ' || chr(10)) as context_after from nb",
    "x14_mock": """with m as (select doc_id, text, regexp_matches(text, '(?i)rsa') as rsa, regexp_matches(text, '(?i)aes') as aes, regexp_matches(text, '(?i)sha-?256') as s2, regexp_matches(text, '(?i)sha-?512') as s5, regexp_matches(text, '(?i)md5') as md, regexp_matches(text, '(?i)kyber|ml-kem') as ky, regexp_matches(text, '(?i)dilithium|ml-dsa') as di, regexp_matches(text, '(?i)[0-9]{3,4}(bit|-bit)') as kb, regexp_matches(text, '(?i)gcm|cbc|ecb|ctr') as mo from documents)
      select doc_id, true as success, case when di then 'Dilithium/ML-DSA' when ky then 'Kyber/ML-KEM' when md then 'MD5' when s5 then 'SHA-512' when s2 then 'SHA-256' when aes then 'AES' when rsa then 'RSA' else 'unknown' end as algorithm, case when kb then try_cast(regexp_extract(text, '(?i)([0-9]{3,4})\\s*(bit|bitleng|-bit)', 1) as int) end as key_length,
      case when mo then 'GCM/CBC/ECB/CTR' end as mode, ky or di as is_pqc_safe, case when mo then 0.6 when kb then 0.7 when di or ky then 0.9 when md or s5 or s2 then 0.8 when aes or rsa then 0.7 else 0.3 end::double as confidence from m""",
    "x15_json_reply": "with t as (select event_id, regexp_extract('the answer is ' || props || case when event_id % 3 = 0 then ' trailing } brace' else ' done' end, '(?s)\\{.*\\}') as b from events) select event_id, json_valid(b) as success, case when json_valid(b) then json_extract(b, '$.k')::int end as k from t",
    "s01_repository_rows": f"with code as ({CODE_FILES_SQL}), paths as (select ({_sql_list(FOLDERS)})[(file_id % {len(FOLDERS)} + 1)::int] || '/' || path as path, content from code) select substr(sha256(path), 1, 16) as file_id, path, strlen(content) as length, sha256(content) as sha256, null::varchar as error from paths where regexp_matches(path, '[.](py|java|c|cpp|h|hpp|go|js|ts)$') and not {_out}",
    "c21_merged_maps": "select l_orderkey, l_linenumber, l_returnflag as new_flag, l_partkey::varchar as new_status, l_suppkey::varchar as new_how, l_returnflag as old_flag, l_linestatus as old_status, l_suppkey::varchar as old_how from lineitem",
    "c28_outcomes": "with e as (select user_id as ticker, arg_min(value, {'ts': ts, 'id': event_id}) as first, arg_max(value, {'ts': ts, 'id': event_id}) as last from events group by 1) select ticker, round((last - first) / nullif(first, 0.0) * 100.0, 6) as change, round(1000.0 + 1000.0 * ((last - first) / nullif(first, 0.0) * 100.0) / 100.0, 6) as worth from e",
    "c29_fit_bands": "with f as (select user_id as ticker, value as x, lead(value) over (partition by user_id order by ts, event_id) as y from events), r as (select ticker, regr_r2(y, x) as r2, count(*) as n from f where y is not null group by 1) select ticker, case when r2 > 0.9 then 'very high' when r2 > 0.8 then 'high' when r2 > 0.7 then 'medium' else 'low' end as band, n from r",
    "c30_example_bands": f"with {SCORED} select algorithm, case when risk > 80 then 'critical' when risk > 60 then 'high' when risk > 40 then 'medium' else 'low' end as band, count(*) as n from scored group by 1, 2",
    "o03_limited_files": f"with {_paths} select min(path) as path from paths where regexp_matches(path, '[.](py|java|c|cpp|h|hpp|go|js|ts)$') and not {_out} group by lower(path) order by path limit 50",
    "o04_snippets": "with p as (select doc_id as file_id, i as chunk, substring(text, i * 2000 + 1, 2000) as t from (select doc_id, text, unnest(range(0, ceil(length(text) / 2000.0)::bigint))::int as i from documents) where i < 2) select file_id, chunk, md5(t) as md5 from p where length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) >= 50",
    "s01_profile_files": f"with {_paths} select min(path) as path from paths where regexp_matches(path, '[.](py|java|c|cpp|h|hpp|go|js|ts)$') and not {_out} group by lower(path)",
    "s03_excluded": f"with {_paths} select distinct path, {_out} as out from paths",
    "s10_decode": "select doc_id, length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))::int as chars from documents",
    "s20_file_hash": "select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from documents",
    "a01_fold": f"with {SCAN} select file_id, algorithm, count(*) as occurrences, max(confidence) as confidence, string_agg('Line ' || line, ',' order by 'Line ' || line) as locations from hits group by file_id, algorithm",
    "a02_file_summary": f"with {SCAN} select file_id, count(*) as total_crypto_functions, count(distinct algorithm) as unique_algorithms from hits group by file_id",
    "a03_bom_summary": f"with {SCORED} select repo_id, count(*) as total_algorithms, sum((pqc > 50)::int)::bigint as pqc_compliant, sum((pqc <= 50)::int)::bigint as legacy_algorithms, round_even(avg(risk), 2) as average_risk, least(100.0, avg(risk)) as risk_score from scored group by repo_id",
    "a05_recommendations": f"with {SCORED} select case when risk >= 80 then 'critical_issues' when risk >= 60 then 'high_priority' when risk >= 40 then 'medium_priority' else 'low_priority' end as bucket, {_rec} as recommendation, case status when 'legacy' then {_text(rules.MITIGATIONS['legacy'])} when 'broken' then {_text(rules.MITIGATIONS['broken'])} end as mitigation, count(*) as n, max(risk) as worst from scored group by 1, 2, 3",
    "a06_repository_summary": f"with {ASSETS}, {RISK}, s as (select repo_id, coalesce(base, 50.0::double) * 0.7::double + coalesce(pqc, 0.0::double) * 0.3::double as risk, coalesce(pqc, 0.0) as pqc from assets left join risks using (algorithm)) select repo_id, count(*) as total_algorithms, sum((pqc > 50)::int)::bigint as pqc_compliant, sum((pqc <= 50)::int)::bigint as legacy_algorithms, round_even(avg(risk), 2) as average_risk, avg(risk) as risk_score from s group by repo_id",
    "a07_layers": f"with {ASSETS} select repo_id, case when detectors = ['java_import_signal'] then 'context_crypto' else 'confirmed_crypto' end as layer, count(*) as n from assets group by 1, 2",
    "a08_split_counts": f"{LABELLED} select repo_id, {_counts} from dec group by repo_id",
    "a14_algorithm_counts": f"with {OBS} select algorithm, count(*) as n from obs group by 1",
    "a15_pqc_ready": f"with {SCORED} select pqc > 50 as ready, count(*) as n from scored group by 1",
    "a16_risk_levels": f"with {SCORED} select repo_id, " + ", ".join(f"sum(({LEVEL} = '{x}')::int)::bigint as {x}" for x in ("critical", "high", "medium", "low")) + " from scored group by 1",
    "a17_field_averages": f"{LABELLED} select unnest(['algorithm', 'category', 'key_length', 'mode', 'padding', 'usage']) as field, unnest([round_even(avg(base), 3), 0.95, round_even(avg(kc), 3), round_even(avg(mc), 3), round_even(avg(pc), 3), round_even(avg(base), 3)])::double as avg_confidence from dec",
    "a18_decision_summary": f"{LABELLED} select algorithm, count(*) as total, sum(include::int)::bigint as included, sum((not include and final_action = 'require_review')::int)::bigint as review, sum((not include and final_action <> 'require_review')::int)::bigint as dropped, round_even(sum((not include and final_action <> 'require_review')::int)::double / count(*) * 100.0::double, 2) as drop_rate, round_even(sum(quality_score) / count(*), 2) as avg_quality from dec group by 1",
    "a19_quality_histogram": f"{LABELLED} select least(9, floor(quality_score / 10))::bigint as bin, count(*) as n from dec group by 1",
    "a20_severities": f"{LABELLED} select max_severity, count(*) as n from dec group by 1",
    "a21_issue_severities": f"{LABELLED}, i as (select unnest(issues) as issue from dec) select issue, case when regexp_matches(issue, 'cross_algorithm|invalid|contamination') then 'high' when contains(issue, 'removed') then 'medium' else 'low' end as severity, case when regexp_matches(issue, 'cross_algorithm|invalid|contamination') then 3 when contains(issue, 'removed') then 2 else 1 end as severity_score, count(*) as n from i group by 1, 2, 3",
    "a22_set_sizes": f"{LABELLED}, c as (select {_counts} from dec) select unnest(['all', 'training', 'review', 'policy_drop', 'quality_reject', 'dropped']) as stage, unnest([assets_total, training, review, policy_drop, quality_reject, dropped]) as n from c",
    "a23_validity": f"{LABELLED} select algorithm, sum((len(issues) = 0)::int)::bigint as valid, sum((len(issues) > 0)::int)::bigint as invalid, round_even(avg(base), 3) as avg_confidence from dec group by 1",
    "c01_risk_score": f"with {SCORED} select ref, algorithm, key_length, risk, {LEVEL} as level from scored",
    "c03_primitive_type": _name(PRIMITIVE), "c04_functions": _name(FUNCTIONS), "c05_family": _name(FAMILY), "c06_category": _name(CATEGORY), "c07_pqc_status": _name(STATUS), "c18_normal_name": f"with {OBS}, n as (select ref, algorithm, '  ' || replace(algorithm, 'AES', 'Advanced Encryption Standard') || chr(9) as x from obs) select ref, algorithm, {_synonyms} as value from n",
    "c10_labels": f"""with {OBS}, {VALID.replace('{SRC}', 'obs')} select ref, category, family, case when key_length_state = 'known' then key_length::varchar end as key_length_value, key_length_state, case key_length_state when 'known' then 'detected_or_inferred' when 'unknown' then 'not_detected' else case category when 'rng' then 'rng_key_length_not_applicable' else 'hash_functions_do_not_use_key_length' end end as key_length_reason,
      case when mode_state = 'known' then mode end as mode_value, mode_state, case when ms = 'bad' then 'mode_not_in_known_set' when ms = 'rsa' then 'rsa_does_not_use_mode' when ms = 'known' then 'detected_or_inferred' when ms = 'unknown' then 'not_detected' else case category when 'rng' then 'rng_mode_not_applicable' when 'mac' then 'mac_does_not_use_block_mode' when 'key_exchange' then 'key_exchange_does_not_use_mode' when 'hash_function' then 'hash_functions_do_not_use_mode' else 'asymmetric_algorithms_do_not_use_mode' end end as mode_reason,
      case when padding_state = 'known' then padding end as padding_value, padding_state, case when ps = 'aead' then 'padding_not_used_in_aead_or_ctr' when ps = 'known' then 'detected_or_inferred' when ps = 'unknown' then case category when 'asymmetric_cryptography' then 'padding_may_apply_but_not_detected' else 'not_detected' end else case category when 'rng' then 'rng_padding_not_applicable' when 'mac' then 'mac_does_not_use_padding' when 'key_exchange' then 'key_exchange_does_not_use_padding' else 'hash_functions_do_not_use_padding' end end as padding_reason,
      array_to_string(issues, ',') as issues, len(issues) = 0 as is_valid, pqc_status, case when pqc_status = 'unknown' then 0.4 else 0.9 end::double as pqc_confidence from v3""",
    "c12_decisions": f"{LABELLED} select ref, max_severity, final_action, unknown_ratio, issue_count, severity_penalty, round(favg, 9) as field_confidence_avg, include, array_to_string(reasons, ',') as reasons, split from dec",
    "c12_quality_bounds": f"{LABELLED} select algorithm, split, count(*) as n, min(quality_score) as low, max(quality_score) as high from dec group by 1, 2",
    "c19_size_text": "with n as (select doc_id, (n_chars * doc_id * doc_id)::double as b from documents) select doc_id, case when b < 1024 then printf('%.2f B', b) when b < 1048576 then printf('%.2f KB', b / 1024) when b < 1073741824 then printf('%.2f MB', b / 1048576) else printf('%.2f GB', b / 1073741824) end as size from n",
    "c20_json_validity": "select event_id, json_valid(case when event_id % 5 = 0 then props || '}' else props end) as ok from events",
    "c22_chunks": "with c as (select doc_id as file_id, unnest(range(((length(text) + 1999) // 2000)::bigint)) as chunk, text from documents) select file_id, chunk::int as chunk, length(substring(text, chunk * 2000 + 1, 2000))::int as n, md5(substring(text, chunk * 2000 + 1, 2000)) as md5 from c",
    "c23_cache_keys": "select conv_id, turn, sha256('mock|rules|' || text) as key from conversations",
    "c26_pqc_flags": f"with {SCORED} select ref, pqc > 50 as safe, case when pqc > 80 then 'standardized' else 'legacy' end as label from scored",
    "c31_migrations": f"with {OBS}, m as (select * from {_values(rules.MIGRATIONS, 'algorithm, target, timeline, b, a')}) select algorithm, target, timeline, count(*) as n, sum(b - a)::bigint as gain from obs join m using (algorithm) group by 1, 2, 3",
    "c32_github_urls": "with u as (select page_id, case when page_id % 2 = 0 then 'https://github.com/org' || page_id || case when page_id % 4 = 0 then '/repo' else '/' end else url end as u from pages) select page_id, regexp_matches(u, '^https://(?i:github[.]com)/+[^/?#]+/+[^/?#]+') as ok from u",
    "k06_safe_names": "with n as (select p_partkey, regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') as x from part) select p_partkey, case when x = '' then 'run' else x end as name from n",
    "f08_candidates": f"with {ASSETS}, n as (select file_id, count(*) as n from hits group by 1) select distinct file_id from assets join n using (file_id) where confidence <= 0.8 or regexp_matches(lower(algorithm), 'generic|unknown') or n >= 8",
    "f12_layer": f"with {ASSETS} select file_id, algorithm, case when detectors = ['java_import_signal'] then 'context_crypto' else 'confirmed_crypto' end as layer from assets",
    "f17_risk_references": f"with {OBS}, {RISK} select algorithm, case when pqc > 50 then 'pqc' else 'legacy' end as reference, pqc, base, count(*) as assets, count(distinct repo_id) as repositories from obs join risks using (algorithm) where pqc > 50 or (pqc < 50 and base > 50) group by all",
    "f20_label_table": f"{FILES_LABELLED} select algorithm, family, category, key_length_state, mode_state, padding_state, pqc_status, len(issues) = 0 as is_valid, issue_count from dec",
    "f21_decision_table": f"{LABELLED} select ref, algorithm, include, final_action, max_severity, quality_score, quality_tier, unknown_ratio, evidence_count, case when len(reasons) = 0 then 'none' else array_to_string(reasons, ', ') end as reasons from dec",
    "f22_algorithm_table": f"with {SCORED} select ref, algorithm, {PRIMITIVE} as type, key_length, pqc > 50 as is_pqc_safe, confidence, round_even(risk, 1) as risk from scored",
    "j04_evidence": f"with {ASSETS}, f as (select file_id, algorithm, arg_min(trim(snippet), phase * 1000000 + ord * 1000 + line) as first_snippet from hits group by 1, 2) select file_id, algorithm, evidence_count::int as evidence_count, first_snippet from assets join f using (file_id, algorithm)",
    "j10_issue_policies": f"{LABELLED}, i as (select upper(unnest(issues)) as issue from dec), p as (select * from {_values(rules.POLICY, 'issue, severity, action')}) select issue, severity, action, count(*) as n from i join p using (issue) group by 1, 2, 3",
    "j15_snippet_cache": "select sha256('mock|rules|' || text) as key, count(*) as n, min(doc_id) as first from documents group by 1",
    "t01_instructions": f"{FILES_LABELLED}, f as (select file_id, algorithm, arg_min(trim(snippet), phase * 1000000 + ord * 1000 + line) as input from hits group by 1, 2) select input, algorithm, category, key_length_state, pqc_status, {FUNCTIONS} as usage, include::int as include, final_action as decision_action, quality_tier, split from dec join f using (file_id, algorithm)",
    "w03_rolling": f"with {PRICES} select event_id, case when count(close) {_week} = 7 then round(avg(close) {_week}, 6) end as ma_7, case when count(close) {_week} = 7 then round(stddev_samp(close) {_week}, 6) end as volatility from p",
    "w05_lag_lead": f"with {PRICES}, w as (select *, lag(close) over (partition by ticker order by ts, event_id) as b, lead(close) over (partition by ticker order by ts, event_id) as next_close, min(ts) over (partition by ticker) as t0 from p) select event_id, round(close / nullif(b, 0) - 1, 6) as daily_return, next_close, (epoch_us(ts) - epoch_us(t0)) // 86400000000 as days, round(high - low, 6) as price_change, round((high + low) / 2, 6) as average_price from w",
    "f19_complete_rows": f"with {PRICES}, w as (select ticker, lag(close) over (partition by ticker order by ts, event_id) as b, lead(close) over (partition by ticker order by ts, event_id) as a, row_number() over (partition by ticker order by ts, event_id) as k from p) select ticker, count(*) as n from w where k >= 7 and b is not null and b <> 0 and a is not null group by 1",
    "w09_last_week": f"with {PRICES}, w as (select *, lag(close) over (partition by ticker order by ts, event_id) as b, lead(close) over (partition by ticker order by ts, event_id) as a, row_number() over (partition by ticker order by ts, event_id) as k from p), c as (select *, row_number() over (partition by ticker order by ts desc, event_id desc) as r, count(*) over (partition by ticker) as n from w where k >= 7 and b is not null and b <> 0 and a is not null) select ticker, n, string_agg(printf('%.4f', close), ',' order by r desc) as closes from c where r <= 7 group by 1, 2",
    "w09_last_rows": f"with {PRICES} select ticker, arg_max(close, struct_pack(ts := ts, e := event_id)) as last_close, count(*) as n from p group by 1",
}
