"""An independent SQL statement per registered query, for the oracle engine."""

from __future__ import annotations

from shiftledger.functions.text import KEY_ACCENTED, KEY_PLAIN
from shiftledger.sources.fixtures import view_sql

_DAYS = ["segunda", "terca", "quarta", "quinta", "sexta"]
_LABELS = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta"]
_FULL = "'Realizado Total'"
_STATUSES = ["Realizado Total", "Realizado Parcial", "Não Realizado", "Não Se Aplica", "Não Informado"]
_AS_OF = "TIMESTAMP '2024-01-31 12:00:00'"
_WEEK = "data_registro >= TIMESTAMP '2024-01-24 12:00:00'"
_REC = "id, data_registro, operador_nome, cliente_nome, status, justificativa, caminho_evidencia, aprovado_gestor"


def _key(name: str) -> str:
    return f"coalesce(lower(translate(split_part(trim({name}), ' ', 1), '{KEY_ACCENTED}', '{KEY_PLAIN}')), '')"


def _pct(k: str, n: str) -> str:
    return f"round_even(({k})::DOUBLE / nullif({n}, 0) * 100, 1)"


def _status(s: str) -> str:
    return f"count(*) FILTER (status = '{s}')"


def _slug(e: str) -> str:
    return f"regexp_replace(lower(strip_accents(coalesce({e}, ''))), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _last(value: str, written: str) -> str:
    return f"arg_max({value}, ordem) FILTER ({written})"


def _moment(column: str) -> str:
    return f"coalesce(regexp_replace(CAST({column} AS VARCHAR), '(\\.\\d*[1-9])0+$', '\\1'), '')"


def _audit(action: str, details: str, source: str, where: str = "true") -> str:
    return (
        f"SELECT CAST(NULL AS BIGINT) AS id, {_AS_OF} AS timestamp, 'gestor' AS usuario_login, CAST(NULL AS VARCHAR) AS usuario_nome, "
        f"CAST(NULL AS VARCHAR) AS ip_origem, '{action}' AS acao, {details} AS detalhes FROM {source} WHERE {where}"
    )


def _differs(name: str, old: str, new: str) -> str:
    return f"CASE WHEN {old} IS DISTINCT FROM {new} THEN '{name}: ' || coalesce({old}, '') || ' -> ' || coalesce({new}, '') END"


_PATCH_DATE = (
    "CASE WHEN regexp_full_match(trim(data_registro), '\\d{8}') THEN strptime(trim(data_registro), '%Y%m%d') "
    "WHEN regexp_full_match(trim(data_registro), '\\d{8}T\\d{6}') THEN strptime(trim(data_registro), '%Y%m%dT%H%M%S') "
    "WHEN regexp_full_match(trim(data_registro), '\\d{4}-W\\d{2}-\\d') THEN strptime(trim(data_registro), '%G-W%V-%u') "
    "WHEN regexp_full_match(trim(data_registro), '\\d{4}-\\d{2}-\\d{2}T\\d{4}') THEN try_strptime(trim(data_registro), '%Y-%m-%dT%H%M') "
    "WHEN length(trim(data_registro)) = 10 THEN try_cast(trim(data_registro) AS DATE) + INTERVAL 12 HOUR ELSE "
    "try_cast(regexp_replace(regexp_replace(regexp_replace(trim(data_registro), '(Z|[+-]\\d\\d:\\d\\d(:\\d\\d)?)$', ''), 'T', ' '), "
    "'(\\.\\d{6})\\d+$', '\\1') AS TIMESTAMP) END"
)
_NEW_TOP = "(SELECT greatest(max(r.id), (SELECT max(s.id) FROM submissions s)) FROM records r)"


# Helper views over the derived tables.
_HELPERS = {
    "keyed": (["records"], f"SELECT *, {_key('operador_nome')} AS op_key FROM records"),
    "op_labels": (["keyed"],
        "SELECT op_key, coalesce(arg_min(nome, (-length(nome), nome)), 'Sem nome') AS operador_exibicao FROM "
        "(SELECT op_key, nullif(trim(operador_nome), '') AS nome FROM keyed) GROUP BY op_key"),
    "canon": (["keyed", "op_labels"], "SELECT * FROM keyed JOIN op_labels USING (op_key)"),
    "chosen": (["canon"],
        f"SELECT * FROM canon WHERE data_registro >= {_AS_OF} - INTERVAL 30 DAY AND status = 'Realizado Parcial' AND cliente_nome = 'Client 7'"),
    "rated": (["canon"],
        f"SELECT operador_exibicao AS operador, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM canon GROUP BY 1"),
    "cells": (["schedule"], " UNION ALL ".join(
        f"SELECT id, trim(operador) AS operador, periodo, {i} AS dia_idx, '{d}' AS dia, "
        f"nullif(nullif(trim({d}), ''), '-') AS cliente FROM schedule" for i, d in enumerate(_DAYS))),
    "expected": (["cells"],
        "SELECT d::DATE AS dia, id, operador, cliente, upper(operador) AS o, upper(cliente) AS c FROM cells "
        "JOIN range(DATE '2024-01-08', DATE '2024-01-22', INTERVAL 1 DAY) AS r(d) ON isodow(d) - 1 = dia_idx "
        "WHERE cliente IS NOT NULL AND operador <> ''"),
    "reported": (["records"],
        "SELECT DISTINCT data_registro::DATE AS dia, upper(trim(coalesce(operador_nome, ''))) AS o, "
        "upper(trim(coalesce(cliente_nome, ''))) AS c FROM records WHERE data_registro IS NOT NULL"),
    "missing": (["expected", "reported"],
        "SELECT e.* FROM (SELECT *, row_number() OVER (PARTITION BY dia, o, c ORDER BY id) AS n FROM expected) e "
        "WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM reported r WHERE r.dia = e.dia AND r.o = e.o AND r.c = e.c)"),
    "filled": (["missing"],
        "SELECT CAST(NULL AS BIGINT) AS id, dia + INTERVAL '23:59:00' HOUR TO SECOND AS data_registro, operador AS operador_nome, "
        "cliente AS cliente_nome, 'Não Informado' AS status, "
        "'Preenchido automaticamente — operador não lançou no dia.' AS justificativa, "
        "CAST(NULL AS VARCHAR) AS caminho_evidencia, 'Pendente' AS aprovado_gestor FROM missing"
        .replace("INTERVAL '23:59:00' HOUR TO SECOND", "INTERVAL 86340 SECOND")),
    "numbered": (["filled", "records"],
        "SELECT CAST(row_number() OVER (ORDER BY data_registro, operador_nome, cliente_nome) + (SELECT max(id) FROM records) AS BIGINT) AS id, "
        + _REC[4:] + " FROM filled"),
    "valid_submissions": (["ingested"],
        f"SELECT * FROM ingested WHERE aceito AND cliente_nome NOT IN ('', 'Selecione...') AND (status = {_FULL} OR trim(justificativa) <> '') "
        "AND status IN ('Realizado Total', 'Realizado Parcial', 'Não Realizado', 'Não Se Aplica', 'Não Informado')"),
    "delivered": (["valid_submissions", "submissions"],
        "SELECT *, CASE WHEN ordem * 3 <= m THEN 0 WHEN ordem * 3 <= 2 * m THEN 1 ELSE 2 END AS d "
        "FROM valid_submissions, (SELECT max(ordem) AS m FROM submissions)"),
    "created": (["delivered", "records"],
        f"SELECT CAST((SELECT max(id) FROM records) + row_number() OVER (ORDER BY ordem) AS BIGINT) AS id, {_REC[4:]}, ordem, d FROM delivered WHERE id IS NULL"),
    "steps": (["delivered", "created", "records"],
        f"SELECT {_REC}, -1 AS d FROM records UNION ALL SELECT {_REC}, d FROM (SELECT {_REC}, ordem, d FROM created UNION ALL "
        f"SELECT {_REC}, ordem, d FROM delivered u WHERE id IN (SELECT id FROM records) OR EXISTS (SELECT 1 FROM created c WHERE c.id = u.id AND c.ordem < u.ordem)) "
        "QUALIFY row_number() OVER (PARTITION BY id, d ORDER BY ordem DESC) = 1"),
    "plan_lines": (["schedule", "payload_rows"],
        "SELECT id, " + ", ".join(["operador", "periodo", *_DAYS]) + ", id NOT IN (SELECT id FROM schedule) AS novo FROM "
        "(SELECT * FROM payload_rows WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordem DESC) = 1) UNION ALL "
        "SELECT CAST(row_number() OVER (ORDER BY ordem) + (SELECT greatest((SELECT max(id) FROM schedule), (SELECT max(id) FROM payload_rows))) AS BIGINT), "
        + ", ".join(["operador", "periodo", *_DAYS]) + ", true FROM payload_rows WHERE id IS NULL"),
    "patched_last": (["patches"],
        f"SELECT id, {_last('trim(cliente_nome)', 'cliente_nome IS NOT NULL')} AS c, {_last('trim(status)', 'status IS NOT NULL')} AS s, "
        + _last("trim(coalesce(justificativa, ''))", "tem_justificativa") + " AS j, " + _last("trim(operador_nome)", "coalesce(operador_nome, '') <> ''") + " AS o, "
        + _last("data_registro", "data_registro IS NOT NULL")
        + f" AS d FROM (SELECT * REPLACE ({_PATCH_DATE} AS data_registro), data_registro AS bruto FROM patches) "
        "WHERE bruto IS NULL OR data_registro IS NOT NULL GROUP BY id"),
    "plan_names": (["schedule"], "SELECT DISTINCT coalesce(nullif(trim(operador), ''), '-') AS nome_escala FROM schedule"),
    "resolved": (["records", "plan_names"],
        "SELECT r.operador_nome, coalesce(arg_min(p.nome_escala, (length(p.nome_escala), p.nome_escala)), trim(r.operador_nome)) AS operador_escala "
        "FROM (SELECT DISTINCT coalesce(operador_nome, '') AS operador_nome FROM records) r LEFT JOIN plan_names p "
        "ON trim(r.operador_nome) <> '' AND contains(lower(p.nome_escala), lower(split_part(trim(r.operador_nome), ' ', 1))) GROUP BY r.operador_nome"),
    "ingested": (["submissions", "users"],
        f"SELECT s.ordem, s.id, coalesce({_PATCH_DATE}, {_AS_OF}) AS data_registro, CASE WHEN u.username IS NULL THEN NULL WHEN lower(trim(u.role)) IN ('admin', 'admin master', 'gestor', 'coordenador') "
        "AND trim(coalesce(s.operador_nome, '')) <> '' THEN trim(s.operador_nome) ELSE coalesce(nullif(u.nome, ''), u.username) END AS operador_nome, "
        "trim(coalesce(nullif(s.cliente_nome, ''), s.cliente, '')) AS cliente_nome, s.status, coalesce(s.justificativa, '') AS justificativa, "
        "CAST(NULL AS VARCHAR) AS caminho_evidencia, 'Pendente' AS aprovado_gestor, u.username IS NOT NULL AS aceito "
        "FROM submissions s LEFT JOIN users u ON u.username = s.username"),
    "compared": (["edits", "records"],
        "SELECT *, mudou_cliente_nome OR mudou_status OR mudou_justificativa OR mudou_data_registro AS mudou FROM (SELECT e.id, "
        + ", ".join(f"trim(coalesce(e.{c}, '')) AS {c}" for c in ("cliente_nome", "status", "justificativa"))
        + ", date_trunc('minute', e.data_registro) AS data_registro, "
        + ", ".join(f"r.{c} AS {c}_antes" for c in ("cliente_nome", "status", "justificativa", "data_registro")) + ", "
        + ", ".join(f"trim(coalesce(e.{c}, '')) <> trim(coalesce(r.{c}, '')) AS mudou_{c}" for c in ("cliente_nome", "status", "justificativa"))
        + ", date_trunc('minute', e.data_registro) IS DISTINCT FROM date_trunc('minute', r.data_registro) AS mudou_data_registro "
        "FROM (SELECT * FROM edits WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordem DESC) = 1) e "
        "JOIN records r USING (id))"),
    "judged": (["compared"],
        f"SELECT *, CASE WHEN NOT mudou THEN 'inalterado' WHEN cliente_nome IN ('', 'Selecione...') OR (status <> {_FULL} AND justificativa = '') "
        "OR status NOT IN ('Realizado Total', 'Realizado Parcial', 'Não Realizado', 'Não Se Aplica', 'Não Informado') "
        "THEN 'rejeitado' ELSE 'alterado' END AS resultado FROM compared"),
    "edited": (["judged", "records"],
        "SELECT r.id, coalesce(j.data_registro, r.data_registro) AS data_registro, r.operador_nome, coalesce(j.cliente_nome, r.cliente_nome) AS cliente_nome, "
        "coalesce(j.status, r.status) AS status, coalesce(j.justificativa, r.justificativa) AS justificativa, r.caminho_evidencia, r.aprovado_gestor "
        "FROM records r LEFT JOIN (SELECT * FROM judged WHERE resultado = 'alterado') j USING (id)"),
    "checked": (["new_requests", "users"],
        "SELECT n.id, n.username, trim(n.username) AS usuario, n.solicitado_em, CASE WHEN u.username IS NULL THEN 'nao_encontrado' "
        "WHEN coalesce(u.email, '') <> '' AND coalesce(n.email, '') <> '' AND lower(trim(u.email)) <> lower(trim(n.email)) THEN 'nao_confere' "
        "WHEN coalesce(u.telefone, '') <> '' AND coalesce(n.telefone, '') <> '' AND trim(u.telefone) <> trim(n.telefone) THEN 'nao_confere' "
        "ELSE 'ok' END AS verificacao FROM new_requests n LEFT JOIN users u ON u.username = trim(n.username)"),
    "visible": (["users", "plan_names"],
        "SELECT u.id, lower(trim(u.nome)) AS nome_busca, p.nome_escala FROM users u JOIN plan_names p ON trim(coalesce(u.nome, '')) <> '' "
        "AND lower(trim(u.role)) NOT IN ('admin', 'admin master', 'gestor', 'coordenador', 'visualizador') "
        "AND contains(lower(p.nome_escala), lower(trim(u.nome)))"),
    "effects": (["request_log"],
        "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY usuario ORDER BY quando, id) AS n FROM request_log), "
        "f AS (SELECT usuario, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS quando, CAST(NULL AS VARCHAR) AS acao, "
        "CAST(NULL AS VARCHAR) AS efeito, CAST(NULL AS BIGINT) AS alvo, CAST(NULL AS BIGINT) AS req, CAST(NULL AS TIMESTAMP) AS ate "
        "FROM (SELECT DISTINCT usuario FROM o) UNION ALL SELECT usuario, n, id, quando, acao, efeito, "
        "CASE WHEN efeito = 'aberta' THEN id WHEN efeito <> 'ignorada' THEN r END, "
        "CASE efeito WHEN 'aberta' THEN id WHEN 'usada' THEN NULL WHEN 'rejeitada' THEN NULL ELSE r END, "
        "CASE efeito WHEN 'autorizada' THEN quando + INTERVAL 10 MINUTE WHEN 'usada' THEN NULL WHEN 'rejeitada' THEN NULL ELSE a END "
        "FROM (SELECT *, CASE WHEN acao = 'solicitar' AND r IS NULL THEN 'aberta' WHEN acao = 'autorizar' AND r IS NOT NULL AND a IS NULL THEN 'autorizada' "
        "WHEN acao = 'rejeitar' AND r IS NOT NULL THEN 'rejeitada' WHEN acao = 'usar' AND a IS NOT NULL THEN 'usada' ELSE 'ignorada' END AS efeito "
        "FROM (SELECT o.*, CASE WHEN f.ate < o.quando THEN NULL ELSE f.req END AS r, CASE WHEN f.ate < o.quando THEN NULL ELSE f.ate END AS a "
        "FROM f JOIN o ON o.usuario = f.usuario AND o.n = f.n + 1))) "
        "SELECT id, usuario, quando, acao, efeito, alvo AS solicitacao_id FROM f WHERE n > 0"),
    "late": (["records"],
        "SELECT * FROM records WHERE status = 'Não Informado' AND data_registro < "
        "(SELECT max(data_registro) FROM records WHERE status IS DISTINCT FROM 'Não Informado') - INTERVAL 2 DAY"),
    "swept": (["requests"],
        "SELECT * REPLACE (CASE WHEN status = 'autorizado' AND expira_em < TIMESTAMP '1998-06-01' THEN 'expirado' ELSE status END AS status) FROM requests"),
    "payload_rows": (["plan_payloads"],
        "SELECT ordem, id, coalesce(upper(coalesce("
        + ", ".join(f"nullif(trim(payload->>'$.{k}'), '')" for k in ("operador", "Operador")) + ")), 'SEM NOME') AS operador, "
        "upper(coalesce(" + ", ".join(f"nullif(trim(payload->>'$.{k}'), '')" for k in ("periodo", "Periodo")) + ", 'MANHÃ')) AS periodo, "
        + ", ".join(
            "coalesce(" + ", ".join(f"nullif(trim(payload->>'$.\"{k}\"'), '')" for k in keys) + f", '-') AS {d}"
            for d, keys in {
                "segunda": ("segunda", "Segunda"), "terca": ("terca", "Terca", "Terça"), "quarta": ("quarta", "Quarta"),
                "quinta": ("quinta", "Quinta"), "sexta": ("sexta", "Sexta")}.items())
        + " FROM plan_payloads"),
}

_CAPABLE = {
    "can_edit": "'admin', 'admin master', 'gestor', 'coordenador', 'operador'",
    "can_launch": "'admin', 'admin master', 'gestor', 'coordenador', 'operador', 'visualizador'",
    "read_only": "'visualizador'",
    "management": "'admin', 'admin master', 'gestor', 'coordenador'",
    "full_view": "'admin', 'admin master', 'gestor', 'coordenador', 'visualizador'",
}
_KPI = (f"count(*) AS total, {_status('Realizado Total')} AS realizados, {_status('Realizado Parcial')} AS parciais, "
        f"{_status('Não Realizado')} AS nao_realizados")
_DASH = {
    "Data": "strftime(data_registro, '%d/%m/%Y %H:%M')", "Operador": "operador_nome", "Cliente": "cliente_nome",
    "Status": "status", "Justificativa": f"CASE WHEN status = {_FULL} THEN '' ELSE justificativa END", "ID": "id",
}


# key -> (views, statement)
_SQL: dict[str, tuple[list[str], str]] = {
    "records_scan": (["records"], f"SELECT {_REC} FROM records"),
    "schedule_scan": (["schedule"], "SELECT id, operador AS \"Operador\", periodo AS \"Periodo\", "
        + ", ".join(f'{d} AS "{x}"' for d, x in zip(_DAYS, _LABELS)) + " FROM schedule"),
    "json_envelope": ([], "SELECT event_id AS id, 'op ' || user_id AS operador_nome, event_type AS status FROM events"),
    "schedule_conform": (["raw_schedule"], "SELECT \"ID\" AS id, " + ", ".join(
        f"CASE WHEN coalesce(trim({c}), '') IN ('', 'nan', 'None') THEN '-' ELSE trim({c}) END AS \"{n}\"" for n, c in {
            "Operador": '"Analista"', "Periodo": '"período"', "Segunda": '"SEGUNDA"', "Terça": '"terça"',
            "Quarta": '"Quarta"', "Quinta": '"quinta"', "Sexta": "NULL"}.items()) + " FROM raw_schedule"),
    "report_dates": (["patches"], "SELECT ordem, data_registro, try_cast(regexp_replace(trim(data_registro), '(Z|[+-]\\d\\d:\\d\\d)$', '') AS TIMESTAMP) AS data_dt FROM patches"),
    # A CSV report leaves both null and '' blank.
    "export_csv": (["records"], "SELECT * REPLACE (nullif(justificativa, '') AS justificativa) FROM records"),
    "snapshot_manifest": (["records", "schedule"],
        "SELECT 'registros' AS tabela, count(*) AS linhas FROM records UNION ALL SELECT 'cronograma', count(*) FROM schedule"),
    "records_partitioned": (["records"], f"SELECT {_REC} FROM records WHERE {_WEEK}"),
    "audit_from_edits": (["judged"], _audit("editar_registro", "concat_ws('; ', 'registro ' || id, " + ", ".join(
        f"CASE WHEN mudou_{c} THEN {_differs(c, c + '_antes', c)} END" for c in ("cliente_nome", "status", "justificativa"))
        + ", CASE WHEN mudou_data_registro AND data_registro IS NOT NULL AND data_registro IS DISTINCT FROM data_registro_antes THEN "
        f"'data_registro: ' || {_moment('data_registro_antes')} || ' -> ' || CAST(data_registro AS VARCHAR) END)", "judged", "resultado = 'alterado'")),
    "audit_from_patches": (["patched_last", "records"], _audit(
        "atualizar_registro", "concat_ws('; ', 'registro ' || id, m)",
        "(SELECT r.id, concat_ws('; ', " + ", ".join(
            _differs(c, f"r.{c}", f"coalesce(p.{k}, r.{c})") for c, k in {"cliente_nome": "c", "status": "s", "justificativa": "j", "operador_nome": "o"}.items())
        + f", CASE WHEN p.d IS NOT NULL AND p.d IS DISTINCT FROM r.data_registro THEN 'data_registro: ' || {_moment('r.data_registro')} || ' -> ' || {_moment('p.d')} END"
        + ") AS m FROM records r JOIN patched_last p USING (id))", "m <> ''")),
    "audit_from_deletes": (["records", "tombstones"], _audit(
        "excluir_registro", "'registro ' || id", "records", "id IN (SELECT id FROM tombstones)")),
    "audit_from_inserts": (["numbered"], _audit(
        "criar_registro", "'registro ' || id || '; operador_nome: ' || operador_nome || '; cliente_nome: ' || cliente_nome || '; status: ' || status || "
        "'; data_registro: ' || CAST(data_registro AS VARCHAR)", "numbered")),
    "audit_from_plan": (["plan_lines"], _audit(
        "salvar_cronograma", "'linha ' || id || '; ' || CASE WHEN novo THEN 'incluída' ELSE 'substituída' END || "
        + " || ".join(f"'; {c}: ' || {c}" for c in ["operador", "periodo", *_DAYS]), "plan_lines")),
    "audit_from_roles": (["role_changes", "users"], _audit(
        "alterar_papel", "'usuário ' || u.id || '; role: ' || u.role || ' -> ' || l.role",
        "users u JOIN (SELECT id, role FROM role_changes WHERE role IN ('Operador', 'Visualizador', 'Gestor', 'Admin') "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordem DESC) = 1) l USING (id)", "u.role <> l.role")),
    "operator_key": (["keyed"], "SELECT id, operador_nome, op_key FROM keyed"),
    "strip_accents": (["records"], "SELECT id, strip_accents(coalesce(operador_nome, '')) AS sem_acento FROM records"),
    "strip_accents_exact": (["records"], "SELECT id, strip_accents(coalesce(operador_nome, '')) AS sem_acento FROM records"),
    "name_slug": (["records"], f"SELECT id, {_slug('operador_nome')} AS slug FROM records"),
    "parse_record_date": (["submissions"], f"SELECT ordem, {_PATCH_DATE} AS data_dt FROM submissions"),
    "fill_missing_dates": (["records"], f"SELECT id, coalesce(data_registro, {_AS_OF}) AS data_registro FROM records"),
    "records_by_weekday": (["records"],
        "SELECT id, data_registro, CAST(isodow(data_registro) - 1 AS INTEGER) AS dia_idx, "
        "CASE isodow(data_registro) WHEN 1 THEN 'segunda' WHEN 2 THEN 'terca' WHEN 3 THEN 'quarta' WHEN 4 THEN 'quinta' WHEN 5 THEN 'sexta' END AS coluna_escala FROM records"),
    "mask_notes": (["records"], f"SELECT id, status, {_DASH['Justificativa']} AS justificativa FROM records"),
    "report_projection": (["records"], "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _DASH.items()) + " FROM records"),
    "control_columns_dropped": (["records"], f"SELECT {_REC[4:]} FROM records"),
    "status_class": (["records"],
        "SELECT id, coalesce(status, '—') AS status_texto, CASE WHEN status IS NULL THEN NULL WHEN status = 'Realizado Total' THEN 'ok' "
        "WHEN status = 'Realizado Parcial' THEN 'warn' WHEN status = 'Não Realizado' THEN 'danger' ELSE 'muted' END AS classe FROM records"),
    "schedule_normalize": (["payload_rows"], "SELECT * FROM payload_rows"),
    "username_quality": (["signups"],
        "SELECT username, u AS username_limpo, length(u) >= 3 AS valido FROM (SELECT username, "
        "regexp_replace(replace(lower(trim(username)), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g') AS u FROM signups)"),
    "email_quality": (["users"],
        "SELECT id, email, coalesce(email = '' OR (contains(trim(email), '@') AND contains(list_extract(string_split(trim(email), '@'), -1), '.')), true) AS valido FROM users"),
    "role_capabilities": (["users"], "SELECT id, role, lower(trim(role)) AS role_norm, "
        + ", ".join(f"lower(trim(role)) IN ({v}) AS {k}" for k, v in _CAPABLE.items()) + " FROM users"),
    "support_options": (["cells"], "SELECT DISTINCT 'Suporte - ' || cliente AS opcao FROM cells WHERE cliente IS NOT NULL"),
    "name_initials": (["users"],
        "SELECT id, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS nome_exibicao, "
        "array_to_string(list_transform(w[1:2], lambda x: upper(x[1])), '') AS iniciais FROM "
        "(SELECT id, string_split(coalesce(nullif(nome, ''), username), ' ') AS w FROM users)"),
    "period_today": (["records"], f"SELECT {_REC} FROM records WHERE data_registro::DATE = DATE '2024-01-21'"),
    "period_last_n": (["records"], f"SELECT {_REC} FROM records WHERE {_WEEK}"),
    "period_last_30": (["records"], f"SELECT {_REC} FROM records WHERE data_registro >= {_AS_OF} - INTERVAL 30 DAY"),
    "period_month": (["records"], f"SELECT {_REC} FROM records WHERE month(data_registro) = 1 AND year(data_registro) = 2024"),
    "filter_attributes": (["canon"],
        f"SELECT {_REC}, op_key, operador_exibicao FROM canon WHERE operador_exibicao = 'Óp0000007 Silva' AND status = {_FULL}"),
    "filter_custom": (["records"],
        f"SELECT {_REC} FROM records WHERE regexp_matches(cliente_nome, 'client 1.$', 'i') AND status = 'Realizado Parcial' "
        "AND data_registro::DATE >= DATE '2024-01-11'"),
    "search_records": (["records"],
        f"SELECT {_REC} FROM records WHERE coalesce(regexp_matches(cliente_nome, '^óp0+1[0-3]|client 7$', 'i'), false) "
        "OR coalesce(regexp_matches(operador_nome, '^óp0+1[0-3]|client 7$', 'i'), false)"),
    "search_schedule": (["schedule"], "SELECT * FROM schedule WHERE "
        + " OR ".join(f"regexp_matches({c}, 'CLIENT 1[25]$', 'i')" for c in ["operador", *_DAYS])),
    "schedule_visibility": (["visible"], "SELECT DISTINCT nome_busca, nome_escala FROM visible"),
    "visibility_bitmaps": (["visible", "plan_names"],
        "SELECT nome_busca, 1 + (numero - 1) // 32768 AS faixa, count(*) AS operadores FROM (SELECT DISTINCT nome_busca, nome_escala FROM visible) "
        "JOIN (SELECT nome_escala, row_number() OVER (ORDER BY nome_escala) AS numero FROM plan_names) USING (nome_escala) GROUP BY ALL"),
    "lines_seen_by_viewer": (["schedule"], "SELECT * FROM schedule WHERE contains(lower(coalesce(nullif(trim(operador), ''), '-')), 'óp0000001')"),
    "viewer_scopes": (["visible", "users"],
        "SELECT id, username, CASE WHEN id IN (SELECT id FROM visible) THEN 'propria' ELSE 'geral' END AS escopo, "
        "CASE WHEN id IN (SELECT id FROM visible) THEN lower(trim(nome)) END AS nome_busca FROM users"),
    "requests_split": (["swept"],
        "SELECT id, username, CASE WHEN status = 'pendente' THEN 'pendentes' ELSE 'historico' END AS lista, "
        "CASE status WHEN 'autorizado' THEN '🟢 ' WHEN 'usado' THEN '✅ ' WHEN 'expirado' THEN '⏱️ ' WHEN 'rejeitado' THEN '🚫 ' ELSE '' END || status AS status_texto, "
        "solicitado_em, autorizado_em, expira_em, autorizado_por FROM swept"),
    "visible_schedule": (["schedule"],
        "SELECT * FROM schedule WHERE contains(lower(coalesce(nullif(trim(operador), ''), '-')), 'óp000000')"),
    "dashboard_kpi": (["chosen"], f"SELECT {_KPI}, " + ", ".join(
        f"coalesce({_pct(_status(s), 'count(*)')}, 0.0) AS {n}" for n, s in {
            "pct_realizados": "Realizado Total", "pct_parciais": "Realizado Parcial",
            "pct_nao_realizados": "Não Realizado", "eficiencia": "Realizado Total"}.items()) + " FROM chosen"),
    "dashboard_ranking": (["chosen"],
        f"SELECT operador_exibicao AS operador, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM chosen GROUP BY 1"),
    "dashboard_trend": (["chosen"],
        f"SELECT data_registro::DATE AS dia, count(*) AS quantidade, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM chosen WHERE data_registro IS NOT NULL GROUP BY 1"),
    "request_counts": (["requests"], "SELECT count(*) FILTER (status = 'pendente') AS pendentes, count(*) FILTER (status <> 'pendente') AS historico FROM requests"),
    "gap_detect_day": (["missing"], "SELECT dia, id AS linha_id, operador, cliente FROM missing WHERE dia = DATE '2024-01-15'"),
    "gap_detect_range": (["missing"], "SELECT dia, id AS linha_id, operador, cliente FROM missing"),
    "gap_summary": (["expected", "missing"],
        "SELECT d::DATE AS dia, (SELECT count(*) FROM expected e WHERE e.dia = d::DATE) AS esperados, "
        "(SELECT count(*) FROM missing m WHERE m.dia = d::DATE) AS criados, "
        "(SELECT count(*) FROM expected e WHERE e.dia = d::DATE) - (SELECT count(*) FROM missing m WHERE m.dia = d::DATE) AS ja_existiam "
        "FROM range(DATE '2024-01-08', DATE '2024-01-22', INTERVAL 1 DAY) AS r(d)"),
    "gap_details": (["missing"],
        "SELECT id AS linha_id, operador, cliente FROM missing WHERE dia = DATE '2024-01-15' ORDER BY id, cliente LIMIT 50"),
    "gap_fill_rows": (["filled"], f"SELECT {_REC} FROM filled"),
    "gap_rows_numbered": (["numbered"], f"SELECT {_REC} FROM numbered"),
    "records_gap_filled": (["numbered", "records"], f"SELECT {_REC} FROM records UNION ALL SELECT {_REC} FROM numbered"),
    "records_gap_stored": (["numbered", "records"], f"SELECT {_REC} FROM records UNION ALL SELECT {_REC} FROM numbered"),
    "resolve_operator": (["resolved"], "SELECT operador_nome, operador_escala FROM resolved"),
    "records_plan_spelling": (["resolved", "records"],
        "SELECT r.id, r.operador_nome, p.operador_escala FROM records r JOIN resolved p ON p.operador_nome = coalesce(r.operador_nome, '')"),
    "canonical_operator": (["canon"], "SELECT id, op_key, operador_exibicao FROM canon"),
    "names_without_account": (["schedule", "users"],
        f"SELECT nome FROM (SELECT DISTINCT trim(operador) AS nome FROM schedule) WHERE {_slug(chr(34) + 'nome' + chr(34))} IS NOT NULL "
        f"AND {_slug('split_part(nome, chr(32), 1)')} NOT IN (SELECT {_slug('split_part(u.nome, chr(32), 1)')} FROM users u WHERE coalesce(u.nome, '') <> '')"),
    "names_without_account_collated": (["schedule", "users"],
        f"SELECT nome FROM (SELECT DISTINCT trim(operador) AS nome FROM schedule) WHERE {_slug('split_part(nome, chr(32), 1)')} "
        f"NOT IN (SELECT {_slug('split_part(u.nome, chr(32), 1)')} FROM users u WHERE coalesce(u.nome, '') <> '')"),
    "spellings_by_collation": (["records"],
        f"SELECT min(n) AS nome, count(*) AS grafias, CAST(sum(q) AS BIGINT) AS linhas FROM (SELECT split_part(trim(operador_nome), ' ', 1) AS n, count(*) AS q "
        f"FROM records WHERE trim(operador_nome) <> '' GROUP BY 1) GROUP BY {_slug('n')}"),
    # Families with a base that ends in digits are walked one by one, the others are counted.
    "assign_usernames": (["newcomers", "taken_names"],
        f"WITH RECURSIVE n AS (SELECT id, {_slug('split_part(trim(nome), chr(32), 1)')} || '.' || {_slug('sobrenome')} AS base FROM newcomers), "
        "mixed AS (SELECT DISTINCT regexp_replace(base, '\\d+$', '') AS f FROM n WHERE regexp_matches(base, '\\d$')), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM n WHERE regexp_replace(base, '\\d+$', '') NOT IN (SELECT f FROM mixed)), "
        "size AS (SELECT base, count(*) + (SELECT count(*) FROM taken_names) + 1 AS m FROM k GROUP BY base), "
        "cand AS (SELECT base, unnest(range(1, m + 1)) AS s FROM size), "
        "free AS (SELECT base, s, base || CASE WHEN s = 1 THEN '' ELSE CAST(s AS VARCHAR) END AS username FROM cand), "
        "num AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY s) AS k FROM free WHERE username NOT IN (SELECT username FROM taken_names)), "
        "walk AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM n WHERE regexp_replace(base, '\\d+$', '') IN (SELECT f FROM mixed)), "
        "used AS (SELECT list(username) AS u FROM taken_names WHERE regexp_replace(username, '\\d+$', '') IN (SELECT f FROM mixed)), "
        "one AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS username, "
        "coalesce((SELECT u FROM used), []) AS given UNION ALL "
        "SELECT n, id, base, username, list_append(given, username) FROM (SELECT w.n, w.id, w.base, o.given, "
        "list_filter(list_transform(range(1, len(o.given) + 2), lambda i: w.base || CASE WHEN i = 1 THEN '' ELSE CAST(i AS VARCHAR) END), "
        "lambda x: NOT list_contains(o.given, x))[1] AS username FROM one o JOIN walk w ON w.n = o.n + 1)) "
        "SELECT k.id, k.base, num.username FROM k JOIN num USING (base, k) UNION ALL SELECT id, base, username FROM one WHERE n > 0"),
    "request_contact_check": (["checked"], "SELECT id, usuario AS username, verificacao FROM checked"),
    "users_by_department": (["users", "departments"],
        "SELECT u.id, u.username, d.nome AS departamento FROM users u LEFT JOIN departments d ON d.id = u.departamento_id"),
    "kpi_dashboard": (["records"], f"SELECT {_KPI}, " + ", ".join(
        f"coalesce({_pct(_status(s), 'count(*)')}, 0.0) AS {n}" for n, s in {
            "pct_realizados": "Realizado Total", "pct_parciais": "Realizado Parcial",
            "pct_nao_realizados": "Não Realizado", "eficiencia": "Realizado Total"}.items()) + " FROM records"),
    "kpi_week": (["records"], f"SELECT {_KPI} FROM records WHERE {_WEEK}"),
    "kpi_month": (["records"],
        f"SELECT count(*) AS total, {_status('Realizado Total')} AS realizados, {_status('Realizado Parcial')} AS parciais, "
        f"{_pct(_status('Realizado Total'), 'count(*)')} AS eficiencia FROM records WHERE strftime(data_registro, '%Y-%m') = '2024-01'"),
    "status_distribution": (["records"],
        f"SELECT status, count(*) AS qtd, {_pct('count(*)', '(SELECT count(status) FROM records)')} AS participacao FROM records WHERE status IS NOT NULL GROUP BY status"),
    "operator_efficiency": (["rated"], "SELECT * FROM rated"),
    "operator_efficiency_week": (["canon"],
        f"SELECT operador_exibicao AS operador, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM canon WHERE {_WEEK} GROUP BY 1"),
    "insights": (["rated", "records"],
        "WITH r AS (SELECT * FROM rated WHERE total >= 3), p AS (SELECT count(*) AS n, "
        f"{_pct(_status('Realizado Parcial') + ' + ' + _status('Não Realizado'), 'count(*)')} AS taxa FROM records) "
        "SELECT 1 AS ordem, 'melhor' AS tipo, operador, eficiencia AS taxa, total FROM (SELECT * FROM r ORDER BY eficiencia DESC, operador LIMIT 1) WHERE eficiencia >= 80 "
        "UNION ALL SELECT 2, 'pior', operador, eficiencia, total FROM (SELECT * FROM r ORDER BY eficiencia, operador LIMIT 1) WHERE eficiencia < 50 AND total >= 5 "
        "UNION ALL SELECT 3, 'problemas', NULL, taxa, n FROM p WHERE taxa > 35"),
    "operator_status_matrix": (["canon"],
        "SELECT operador_exibicao AS operador, status, count(*) AS qtd FROM canon WHERE status IS NOT NULL GROUP BY ALL"),
    "operator_status_wide": (["canon"],
        "SELECT operador, nivel::INT AS nivel, " + ", ".join(f'"{x}"' for x in _STATUSES) + ", " + " + ".join(f'"{x}"' for x in _STATUSES) + " AS total FROM ("
        "SELECT operador_exibicao AS operador, grouping(operador_exibicao) AS nivel, " + ", ".join(f"count(*) FILTER (status = '{x}') AS \"{x}\"" for x in _STATUSES)
        + " FROM canon WHERE status IS NOT NULL GROUP BY ROLLUP (operador_exibicao))"),
    "daily_volume": (["records"], "SELECT data_registro::DATE AS dia, count(*) AS quantidade FROM records WHERE data_registro IS NOT NULL GROUP BY 1"),
    "daily_efficiency": (["records"],
        f"SELECT data_registro::DATE AS dia, count(*) AS quantidade, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM records WHERE data_registro IS NOT NULL GROUP BY 1"),
    "filter_options": (["canon", "schedule"],
        "SELECT DISTINCT 'operador' AS atributo, operador_exibicao AS valor FROM canon UNION ALL "
        "SELECT DISTINCT 'status', status FROM canon WHERE status IS NOT NULL UNION ALL "
        "SELECT DISTINCT 'cliente', cliente_nome FROM canon UNION ALL "
        "SELECT DISTINCT 'operador_escala', trim(operador) FROM schedule WHERE trim(operador) <> ''"),
    "latest_records": (["records"], f"SELECT {_REC} FROM records ORDER BY data_registro DESC NULLS LAST, id LIMIT 50"),
    "latest_caption": (["records"], "SELECT least(50, count(*)) AS exibidos, count(*) AS total FROM records"),
    "listing_caption": (["records"], "SELECT least(50, count(*)) AS exibidos, count(*) AS total FROM records"),
    "top_clients": (["records"],
        f"SELECT cliente_nome, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM records GROUP BY 1 ORDER BY total DESC, cliente_nome LIMIT 12"),
    "plan_long": (["cells"], "SELECT * FROM cells WHERE cliente IS NOT NULL"),
    "plan_clients_by_day": (["cells"], "SELECT DISTINCT operador, dia_idx, dia, cliente FROM cells WHERE cliente IS NOT NULL"),
    "plan_clients_of_operator": (["cells"],
        "SELECT DISTINCT cliente FROM cells WHERE cliente IS NOT NULL AND dia = 'quarta' AND contains(lower(operador), 'óp0000001')"),
    "plan_clients_all": (["cells"], "SELECT DISTINCT cliente FROM cells WHERE cliente IS NOT NULL"),
    "plan_coverage": (["cells"],
        "SELECT count(DISTINCT operador) AS operadores, count(DISTINCT cliente) AS clientes, "
        "count(DISTINCT dia_idx) FILTER (cliente IS NOT NULL) AS dias_cobertos, count(cliente) AS celulas_preenchidas, count(*) AS celulas, "
        f"{_pct('count(cliente)', 'count(*)')} AS capacidade FROM cells"),
    "day_agenda": (["cells"],
        "SELECT operador, periodo, cliente, true AS tem_alocacao FROM cells WHERE dia = 'segunda' AND cliente IS NOT NULL UNION ALL "
        "SELECT DISTINCT operador, NULL, NULL, false FROM cells WHERE operador NOT IN (SELECT operador FROM cells WHERE dia = 'segunda' AND cliente IS NOT NULL)"),
    "agenda_by_operator": (["cells"],
        "SELECT operador, '[' || coalesce(string_agg('{\"periodo\":\"' || periodo || '\",\"cliente\":\"' || cliente || '\"}', ',' ORDER BY periodo, cliente) "
        "FILTER (cliente IS NOT NULL), '') || ']' AS agenda, count(cliente) > 0 AS tem_alocacao FROM cells WHERE dia = 'terca' GROUP BY operador"),
    "users_listing": (["users"], "SELECT id, nome, username, email, role FROM users"),
    "latest_open_request": (["requests"],
        "SELECT username, id, status, solicitado_em FROM requests WHERE status IN ('pendente', 'autorizado') "
        "QUALIFY row_number() OVER (PARTITION BY username ORDER BY solicitado_em DESC, id DESC) = 1"),
    "latest_authorized_request": (["requests"],
        "SELECT username, id, status, autorizado_em FROM requests WHERE status = 'autorizado' "
        "QUALIFY row_number() OVER (PARTITION BY username ORDER BY autorizado_em DESC, id DESC) = 1"),
    "requests_expired": (["swept"], "SELECT * FROM swept"),
    "request_intake": (["checked", "swept"],
        "SELECT id, usuario AS username, solicitado_em, CASE WHEN verificacao <> 'ok' THEN verificacao WHEN n = 1 AND usuario NOT IN "
        "(SELECT username FROM swept WHERE status IN ('pendente', 'autorizado')) THEN 'registrada' ELSE 'em_andamento' END AS resultado "
        "FROM (SELECT *, row_number() OVER (PARTITION BY usuario, verificacao ORDER BY solicitado_em, id) AS n FROM checked)"),
    "ingest_records": (["ingested", "submissions", "records"],
        f"SELECT * REPLACE (CAST(coalesce(id, {_NEW_TOP} + row_number() OVER (PARTITION BY id IS NULL ORDER BY ordem)) AS BIGINT) AS id) FROM ingested"),
    "record_quality": (["ingested"],
        "SELECT ordem, v AS violacoes, v = '' AS valido FROM (SELECT ordem, concat_ws('; ', "
        "CASE WHEN cliente_nome IN ('', 'Selecione...') THEN 'cliente não informado' END, "
        f"CASE WHEN status <> {_FULL} AND trim(justificativa) = '' THEN 'justificativa obrigatória' END, "
        "CASE WHEN status NOT IN ('Realizado Total', 'Realizado Parcial', 'Não Realizado', 'Não Se Aplica', 'Não Informado') THEN 'status inválido' END) AS v FROM ingested)"),
    "edit_diff": (["compared"], "SELECT * EXCLUDE (mudou) FROM compared WHERE mudou"),
    "edit_outcome": (["judged"], "SELECT resultado, count(*) AS qtd FROM judged GROUP BY 1"),
    "records_edited": (["edited"], "SELECT * FROM edited"),
    "records_edited_in_place": (["edited"], "SELECT * FROM edited"),
    "records_patched": (["patched_last", "records"],
        "SELECT r.id, coalesce(d, data_registro) AS data_registro, coalesce(o, operador_nome) AS operador_nome, coalesce(c, cliente_nome) AS cliente_nome, "
        "coalesce(s, status) AS status, coalesce(j, justificativa) AS justificativa, caminho_evidencia, aprovado_gestor FROM records r LEFT JOIN patched_last p USING (id)"),
    "patch_outcome": (["patches", "records"],
        "SELECT ordem, id, CASE WHEN id IS NULL OR id NOT IN (SELECT id FROM records) THEN 'desconhecido' "
        f"WHEN data_registro IS NOT NULL AND {_PATCH_DATE} IS NULL THEN 'data inválida' ELSE 'aplicado' END AS resultado FROM patches"),
    "delete_outcome": (["tombstones", "records"],
        "SELECT id, count(*) AS pedidos, CASE WHEN id IN (SELECT id FROM records) THEN 'removido' ELSE 'desconhecido' END AS resultado FROM tombstones GROUP BY id"),
    "records_after_delete": (["records", "tombstones"],
        f"SELECT {_REC} FROM records WHERE id NOT IN (SELECT id FROM tombstones WHERE id IS NOT NULL)"),
    "plan_payload_outcome": (["schedule", "plan_payloads"],
        "SELECT ordem, id, CASE WHEN id IS NULL THEN 'incluída' WHEN id NOT IN (SELECT id FROM schedule) THEN 'desconhecido' "
        "WHEN ordem < max(ordem) OVER (PARTITION BY id) THEN 'superada' ELSE 'substituída' END AS resultado FROM plan_payloads"),
    "schedule_upserted": (["schedule", "plan_lines"],
        "SELECT * FROM schedule WHERE id NOT IN (SELECT id FROM plan_lines) UNION ALL BY NAME SELECT * EXCLUDE (novo) FROM plan_lines"),
    "role_changes": (["role_changes", "users"],
        "SELECT c.ordem, c.id, c.role, CASE WHEN c.role NOT IN ('Operador', 'Visualizador', 'Gestor', 'Admin') THEN 'papel_invalido' "
        "WHEN u.id IS NULL THEN 'usuario_desconhecido' ELSE 'aplicado' END AS resultado FROM role_changes c LEFT JOIN users u ON u.id = c.id"),
    "users_after_role_changes": (["role_changes", "users"],
        "SELECT u.* REPLACE (coalesce(l.role, u.role) AS role) FROM users u LEFT JOIN (SELECT id, role FROM role_changes "
        "WHERE role IN ('Operador', 'Visualizador', 'Gestor', 'Admin') QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordem DESC) = 1) l USING (id)"),
    "request_lifecycle": (["effects"], "SELECT * FROM effects"),
    "requests_from_log": (["effects"],
        "SELECT id, username, CASE WHEN usado_em IS NOT NULL THEN 'usado' WHEN rej IS NOT NULL THEN 'rejeitado' "
        f"WHEN autorizado_em + INTERVAL 10 MINUTE < {_AS_OF} THEN 'expirado' WHEN autorizado_em IS NOT NULL THEN 'autorizado' ELSE 'pendente' END AS status, "
        "solicitado_em, autorizado_em, autorizado_em + INTERVAL 10 MINUTE AS expira_em, usado_em FROM ("
        "SELECT solicitacao_id AS id, max(usuario) AS username, max(quando) FILTER (efeito = 'aberta') AS solicitado_em, "
        "max(quando) FILTER (efeito = 'autorizada') AS autorizado_em, max(quando) FILTER (efeito = 'usada') AS usado_em, "
        "max(quando) FILTER (efeito = 'rejeitada') AS rej FROM effects WHERE solicitacao_id IS NOT NULL GROUP BY 1)"),
    "stream_daily_kpi": (["records"],
        f"SELECT data_registro::DATE AS dia, count(*) AS quantidade, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM records WHERE data_registro IS NOT NULL GROUP BY 1"),
    "stream_late_rows": (["late"], f"SELECT {_REC} FROM late"),
    "stream_late_days": (["late", "records"],
        f"SELECT data_registro::DATE AS dia, count(*) AS quantidade, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM records "
        "WHERE data_registro::DATE IN (SELECT data_registro::DATE FROM late) GROUP BY 1"),
    "stream_ingest": (["steps"], f"SELECT {_REC} FROM steps QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC) = 1"),
    "audit_from_stream": (["steps"],
        _audit("criar_registro", "'registro ' || id || '; operador_nome: ' || operador_nome || '; cliente_nome: ' || cliente_nome || '; status: ' || status || "
               f"'; data_registro: ' || {_moment('data_registro')}",
               "(SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 1)", "d >= 0")
        + " UNION ALL " + _audit("atualizar_registro", "concat_ws('; ', 'registro ' || id, m)",
            "(SELECT id, concat_ws('; ', " + ", ".join(
                _differs(c, f"{c}_antes", c) for c in ("cliente_nome", "status", "justificativa", "operador_nome"))
            + f", CASE WHEN data_registro_antes IS DISTINCT FROM data_registro THEN 'data_registro: ' || {_moment('data_registro_antes')} || ' -> ' || {_moment('data_registro')} END"
            + ") AS m FROM (SELECT *, " + ", ".join(
                f"lag({c}) OVER (PARTITION BY id ORDER BY d) AS {c}_antes" for c in ("cliente_nome", "status", "justificativa", "operador_nome", "data_registro"))
            + ", row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM steps) WHERE n > 1)", "m <> ''")),
    "stream_repeats": (["records"], f"SELECT {_REC} FROM records"),
    "stream_request_lifecycle": (["effects"], "SELECT * FROM effects"),
    "stream_grants_run_out": (["effects"],
        "SELECT usuario, solicitacao_id, max(quando) FILTER (efeito = 'autorizada') + INTERVAL 10 MINUTE AS expira_em FROM effects WHERE solicitacao_id IS NOT NULL "
        "GROUP BY 1, 2 HAVING count(*) FILTER (efeito = 'autorizada') > 0 AND count(*) FILTER (efeito IN ('usada', 'rejeitada')) = 0"),
    "stream_gaps": (["missing"], "SELECT dia, id AS linha_id, operador, cliente FROM missing"),
    "stream_series_corrected": (["records"],
        f"SELECT data_registro::DATE AS dia, count(*) AS quantidade, count(status) AS total, count(*) FILTER (status = {_FULL}) AS realizados, "
        f"{_pct(f'count(*) FILTER (status = {_FULL})', 'count(status)')} AS eficiencia FROM records WHERE data_registro IS NOT NULL GROUP BY 1"),
    "stream_request_expiry": (["requests"],
        "SELECT id, username, autorizado_em, expira_em, usado_em, CASE WHEN usado_em IS NULL THEN 'expirado' ELSE 'usado' END AS status FROM requests "
        "WHERE autorizado_em IS NOT NULL AND coalesce(usado_em, autorizado_em) + INTERVAL 600000001 MICROSECOND <= "
        "(SELECT max(coalesce(usado_em, autorizado_em)) FROM requests) - INTERVAL 2 DAY"),
    "ingest_users": (["signups", "users"],
        "SELECT ordem, username, nome, coalesce(nullif(email, ''), username) AS email, coalesce(nullif(role, ''), 'Operador') AS role, "
        "CASE WHEN n = 1 AND username NOT IN (SELECT username FROM users) THEN 'criado' ELSE 'duplicado' END AS resultado "
        "FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY ordem) AS n FROM signups)"),
}


def _closure(names: list[str], found: dict[str, str]) -> dict[str, str]:
    for name in names:
        if name in found:
            continue
        if name in _HELPERS:
            needs, body = _HELPERS[name]
            _closure(needs, found)
            found[name] = body
        else:
            found[name] = view_sql(name)
    return found


def statement(name: str) -> str:
    views, body = _SQL[name]
    found = _closure(views, {})
    if not found:
        return body
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in found.items()) + f" SELECT * FROM ({body})"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in _SQL}
