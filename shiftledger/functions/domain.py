"""Fixed values of the data model. Results depend on these exact spellings."""

FULL = "Realizado Total"
PARTIAL = "Realizado Parcial"
NOT_DONE = "Não Realizado"
NOT_APPLICABLE = "Não Se Aplica"
NOT_REPORTED = "Não Informado"
STATUSES = [FULL, PARTIAL, NOT_DONE, NOT_APPLICABLE, NOT_REPORTED]

MORNING = "MANHÃ"

WEEKDAYS = ["segunda", "terca", "quarta", "quinta", "sexta"]
WEEKDAY_LABELS = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta"]

PENDING = "pendente"
AUTHORIZED = "autorizado"
REJECTED = "rejeitado"
USED = "usado"
EXPIRED = "expirado"
OPEN_REQUEST = [PENDING, AUTHORIZED]
APPROVAL_MINUTES = 10

ASSIGNABLE_ROLES = ["Operador", "Visualizador", "Gestor", "Admin"]
DEFAULT_ROLE = "Operador"
DEFAULT_APPROVAL = "Pendente"

NO_NAME = "Sem nome"
NO_PLAN_NAME = "SEM NOME"
EMPTY_CELL = "-"
MISSING_DISPLAY = "—"
CHOOSE_CLIENT = "Selecione..."
SUPPORT_PREFIX = "Suporte - "
GAP_NOTE = "Preenchido automaticamente — operador não lançou no dia."
