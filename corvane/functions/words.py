"""Word lists and tables that results depend on."""

# Words that state an intent and not a subject.
INTENT_WORDS = (
    "add", "added", "adds", "adiciona", "adicionar", "adjust", "ajusta", "ajustar", "all", "allow", "altera", "alterar", "and", "any", "ao", "aos", "apaga", "apagar", "are",
    "as", "at", "atualiza", "atualizar", "change", "changes", "checar", "check", "com", "confere", "conferir", "conserta", "consertar", "correta", "corretas", "correto",
    "corretos", "corrige", "corrigir", "create", "creates", "cria", "criar", "da", "das", "de", "deletar", "delete", "do", "dos", "em", "esta", "estao", "faz", "fazer", "fix",
    "fixed", "fixes", "for", "from", "implement", "implementa", "implementar", "improve", "in", "inclui", "incluir", "is", "make", "melhora", "melhorar", "mostra", "mostrar",
    "muda", "mudar", "na", "nas", "new", "no", "nos", "nova", "novo", "of", "on", "os", "para", "permite", "permitir", "que", "refactor", "refatora", "refatorar", "remove",
    "remover", "removes", "replace", "revisa", "revisar", "sao", "sem", "ser", "show", "substitui", "substituir", "suporte", "support", "the", "to", "toda", "todas", "todo",
    "todos", "troca", "trocar", "um", "uma", "update", "updated", "updates", "valida", "validadas", "validados", "validar", "validate", "verifica", "verificar", "with",
)

# Words of literals that say nothing about content.
NON_CONTENT_WORDS = (
    "absolute", "active", "alt", "around", "auto", "between", "black", "block", "bold", "border", "bottom", "center", "class", "classname", "client", "col", "cols",
    "container", "cursor", "dark", "default", "disabled", "div", "duration", "ease", "end", "fixed", "flex", "focus", "font", "from", "full", "gap", "gray", "grey", "grid",
    "group", "height", "hidden", "hover", "href", "import", "inline", "items", "justify", "left", "light", "link", "max", "medium", "min", "neutral", "next", "none", "nowrap",
    "opacity", "outline", "overflow", "peer", "pointer", "react", "relative", "right", "ring", "rotate", "rounded", "row", "rows", "sans", "scale", "screen", "select",
    "semibold", "serif", "server", "shadow", "slate", "span", "src", "start", "sticky", "stone", "style", "text", "top", "transform", "transition", "translate", "truncate",
    "use", "via", "white", "whitespace", "width", "wrapper", "zinc",
)

# Task kinds in order, each with the parts of words that tell it.
KIND_HINTS = (
    ("BUG_FIX", ("audit", "broken", "bug", "check", "confer", "conserta", "corrig", "crash", "erro", "falha", "fix", "quebrad", "revis", "valida", "verific")),
    ("TEST", ("cobertura", "coverage", "mock", "spec", "test", "teste")),
    ("REFACTOR", ("extract", "extrai", "limpa", "refactor", "refator", "rename", "renomea", "reorganiz", "simplific")),
    ("MIGRATION", ("converte", "migra", "migrat", "porta", "reescrev", "rewrite")),
    ("EXPLAIN", ("como funciona", "documenta", "entender", "explain", "explica", "o que faz", "onde está", "onde fica")),
    ("FEATURE", ("add", "adiciona", "create", "cria", "implement", "implementa", "nov", "suporte a")),
)

# Language of a file name's ending.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "less": "css", "json": "json", "md": "markdown", "sql": "sql", "yml": "yaml", "yaml": "yaml",
}
PARSED_LANGUAGES = ("typescript", "tsx", "javascript", "python")

# Affinity of an entity type to a task kind; a kind without an entry takes the base, and an unknown type 0.5.
BASE_AFFINITY = {
    "FUNCTION": 1.0, "METHOD": 1.0, "COMPONENT": 1.0, "ENDPOINT": 0.95, "CLASS": 0.85, "SERVICE": 0.85, "CONTROLLER": 0.85, "REPOSITORY": 0.85, "INTERFACE": 0.7,
    "TYPE": 0.65, "TEST": 0.6, "QUERY": 0.6, "FILE": 0.45, "MODULE": 0.45, "CONSTANT": 0.3, "VARIABLE": 0.2,
}
TASK_AFFINITY = {
    "BUG_FIX": {"FUNCTION": 1.0, "METHOD": 1.0, "CLASS": 0.7, "TEST": 0.6, "FILE": 0.3, "CONSTANT": 0.3, "VARIABLE": 0.2},
    "FEATURE": {"FUNCTION": 0.9, "METHOD": 0.9, "CLASS": 0.9, "INTERFACE": 0.8, "TYPE": 0.7, "FILE": 0.4, "CONSTANT": 0.4, "VARIABLE": 0.2},
    "REFACTOR": {"FUNCTION": 1.0, "METHOD": 1.0, "CLASS": 0.9, "TEST": 0.7, "FILE": 0.4, "CONSTANT": 0.3, "VARIABLE": 0.2},
    "TEST": {"FUNCTION": 0.8, "METHOD": 0.8, "TEST": 1.0, "FILE": 0.3},
    "EXPLAIN": {"FUNCTION": 0.8, "ENDPOINT": 0.9, "CLASS": 0.9, "INTERFACE": 0.8, "FILE": 0.8},
    "MIGRATION": {"FUNCTION": 0.8, "CLASS": 0.8, "FILE": 0.9, "MODULE": 0.9},
}

# Weights of the nine signals.
SIGNAL_WEIGHTS = {
    "lexical": 0.25, "symbol_match": 0.20, "graph_proximity": 0.20, "call_relationship": 0.10, "file_importance": 0.05, "task_type": 0.08, "recent_changes": 0.05,
    "test_relationship": 0.07, "semantic": 0.0,
}

# Paths that may hold secrets, and paths left out of a scan.
DENY_PATHS = (
    "**/.env", "**/.env.*", "**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/*.keystore", "**/*.jks", "**/id_rsa", "**/id_dsa", "**/id_ecdsa", "**/id_ed25519", "**/credentials",
    "**/credentials.json", "**/service-account*.json", "**/.npmrc", "**/.pypirc", "**/.aws/**", "**/.ssh/**",
)
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/.next/**", "**/coverage/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/vendor/**", "**/.git/**",
    "**/*.min.js", "**/*.min.css", "**/*.map", "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/poetry.lock",
)

# Edge types that impact follows backwards.
IMPACT_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "REFERENCES", "USES", "RENDERS", "QUERIES", "TESTS")

# Commit subjects that no evaluation case is made of, whatever their case.
REJECTED_SUBJECTS = (
    r"^wip\b", r"^fix(es|ed)?$", r"^ajustes?$", r"^update$", r"^atualiza(ndo|cao|ção)?$", r"^merge\b", r"^revert\b", r"^bump\b", r"^chore", r"^lint", r"^format", r"^primeiro commit$",
    r"^initial commit$",
)
CASE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "py")
