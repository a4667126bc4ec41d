"""Rule tables: what to look for. Every table can be replaced by the caller."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repoaudit.functions.literals import needed_literals
from repoaudit.functions.text import ignore_case


@dataclass(frozen=True)
class SecurityRule:
    """One category of line patterns.

    ``needles`` runs parallel to ``patterns``. Each entry lists groups of lower-case
    ASCII strings; a line can only match the pattern if it holds one string of every
    group. Where a caller gives none, they are read off the pattern. An empty entry means that
    nothing is known, so the pattern always runs. Groups of single characters come first: each
    character is looked for once per line.
    """

    category: str
    severity: str
    description: str
    patterns: tuple[str, ...]
    needles: tuple[tuple[tuple[str, ...], ...], ...] = ()

    def needles_of(self, i: int) -> tuple[tuple[str, ...], ...]:
        return self.needles[i] if i < len(self.needles) else ()


_PAREN, _EQUALS, _QUOTE = ("(",), ("=",), ('"', "'")
_SQL_VERBS = ("select", "insert", "update", "delete")

# Categories, severities, descriptions and patterns, in rule order.
SECURITY_RULES: tuple[SecurityRule, ...] = (
    SecurityRule(
        "hardcoded_api_key",
        "critical",
        "Hardcoded API key or secret detected",
        (
            r"""["'](?:sk-[a-zA-Z0-9]{20,})["']""",
            r"""["'](?:AKIA[A-Z0-9]{16})["']""",
            r"""["'](?:ghp_[a-zA-Z0-9]{36})["']""",
            r"""(?:api_key|apikey|api_secret|API_KEY)\s*=\s*["'][^"'{\$][^"']+""",
            r"""(?:Bearer\s+)[a-zA-Z0-9\-_.]+""",
            r"""["'](?:xox[bprs]-[a-zA-Z0-9\-]+)["']""",
            r"""["'](?:sk_live_[a-zA-Z0-9]{24,})["']""",
            r"""["'](?:rk_live_[a-zA-Z0-9]{24,})["']""",
            r"""["'](?:SK[a-f0-9]{32})["']""",
            r"""["'](?:AIza[0-9A-Za-z\-_]{35})["']""",
            r"""-----BEGIN\s(?:RSA\s)?PRIVATE\sKEY-----""",
        ),
        (
            (_QUOTE, ("sk-",)),
            (_QUOTE, ("akia",)),
            (_QUOTE, ("ghp_",)),
            (_EQUALS, _QUOTE, ("api",)),
            (("bearer",),),
            (_QUOTE, ("xox",)),
            (_QUOTE, ("k_live_",)),
            (_QUOTE, ("k_live_",)),
            (_QUOTE, ('"sk', "'sk")),
            (_QUOTE, ("aiza",)),
            (("-----begin",),),
        ),
    ),
    SecurityRule(
        "hardcoded_password",
        "critical",
        "Hardcoded password or secret",
        (
            r"""(?:password|passwd|pwd|secret|token)\s*=\s*["'][^"'{\$][^"']{3,}["']""",
            r"""(?:mysql|postgres|postgresql|mongodb)://[^:]+:[^@]+@""",
        ),
        (
            (_EQUALS, _QUOTE, ("pass", "pwd", "secret", "token")),
            (("://",), ("@",)),
        ),
    ),
    SecurityRule(
        "sql_injection",
        "high",
        "Potential SQL injection vulnerability",
        (
            r"""(?:execute|cursor\.execute)\s*\(\s*f["']""",
            r"""(?:SELECT|INSERT|UPDATE|DELETE).*%s.*%""",
            r"""\.format\s*\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)""",
            r"""(?:SELECT|INSERT|UPDATE|DELETE).*\.format\s*\(""",
            r"""(?:execute|cursor\.execute)\s*\(\s*["']?\s*(?:SELECT|INSERT|UPDATE|DELETE).*\+""",
        ),
        (
            (_PAREN, ("execute",)),
            (("%s",), _SQL_VERBS),
            (_PAREN, (".format",), _SQL_VERBS),
            (_PAREN, (".format",), _SQL_VERBS),
            (_PAREN, ("execute",), _SQL_VERBS),
        ),
    ),
    SecurityRule(
        "dangerous_exec",
        "high",
        "Dangerous code execution",
        (
            r"""\beval\s*\(""",
            r"""\bexec\s*\(""",
            r"""os\.system\s*\(""",
            r"""subprocess\.call\s*\([^)]*shell\s*=\s*True""",
            r"""subprocess\.Popen\s*\([^)]*shell\s*=\s*True""",
            r"""subprocess\.run\s*\([^)]*shell\s*=\s*True""",
            r"""os\.popen\s*\(""",
            r"""commands\.getoutput\s*\(""",
        ),
        (
            (_PAREN, ("eval",)),
            (_PAREN, ("exec",)),
            (_PAREN, ("os.",)),
            (_PAREN, ("subprocess.",)),
            (_PAREN, ("subprocess.",)),
            (_PAREN, ("subprocess.",)),
            (_PAREN, ("os.",)),
            (_PAREN, ("commands.",)),
        ),
    ),
    SecurityRule(
        "insecure_deserialization",
        "high",
        "Insecure deserialization",
        (
            r"""pickle\.loads?\s*\(""",
            r"""yaml\.load\s*\([^)]*(?!Loader)""",
            r"""marshal\.loads?\s*\(""",
            r"""shelve\.open\s*\(""",
            r"""jsonpickle\.decode\s*\(""",
        ),
        (
            (_PAREN, (".load",)),
            (_PAREN, (".load",)),
            (_PAREN, (".load",)),
            (_PAREN, ("open",)),
            (_PAREN, (".decode",)),
        ),
    ),
    SecurityRule(
        "missing_input_validation",
        "medium",
        "Potential missing input validation on web request data",
        (
            r"""request\.args\.get\s*\(""",
            r"""request\.form\.get\s*\(""",
            r"""request\.json""",
            r"""request\.data""",
        ),
        (
            (("request.",),),
            (("request.",),),
            (("request.",),),
            (("request.",),),
        ),
    ),
    SecurityRule(
        "insecure_http",
        "medium",
        "Insecure HTTP usage or disabled TLS verification",
        (
            r"""http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)""",
            r"""verify\s*=\s*False""",
        ),
        (
            (("http://",),),
            (_EQUALS, ("verify",)),
        ),
    ),
    SecurityRule(
        "debug_in_production",
        "medium",
        "Debug mode enabled — should not be used in production",
        (
            r"""app\.run\s*\([^)]*debug\s*=\s*True""",
            r"""DEBUG\s*=\s*True""",
        ),
        (
            (_EQUALS, ("debug",)),
            (_EQUALS, ("debug",)),
        ),
    ),
    SecurityRule(
        "weak_crypto",
        "medium",
        "Weak or deprecated cryptographic algorithm",
        (
            r"""hashlib\.md5\s*\(""",
            r"""hashlib\.sha1\s*\(""",
            r"""DES\b""",
            r"""RC4\b""",
        ),
        (
            (_PAREN, ("hashlib.",)),
            (_PAREN, ("hashlib.",)),
            (("des",),),
            (("rc4",),),
        ),
    ),
    SecurityRule(
        "path_traversal",
        "high",
        "Potential path traversal vulnerability",
        (
            r"""open\s*\(\s*(?:request|user_input|filename|path)""",
            r"""os\.path\.join\s*\(\s*[^,]+,\s*(?:request|user_input)""",
        ),
        (
            (_PAREN, ("open",), ("request", "user_input", "filename", "path")),
            (_PAREN, ("os.",), ("request", "user_input")),
        ),
    ),
)

# Patterns with several open-ended parts retry every split of a line and turn quadratic
# or worse on long (minified) lines. For a yes/no search the earliest end of each part
# is always the best one, so these atomic forms give the same answer in one pass. Where a
# part must not cross a closing parenthesis, that holds between two of them.
_SQL_VERB = r"(?:SELECT|INSERT|UPDATE|DELETE)"
_BETWEEN = r"(?:\A|\))(?>[^)]*?{call}\s*+\()[^)]*?{option}\s*+=\s*+True"
ONE_PASS_FORMS: dict[str, str] = {
    r"""(?:mysql|postgres|postgresql|mongodb)://[^:]+:[^@]+@""":
        r"""\A(?>.*?(?:mysql|postgres|postgresql|mongodb)://[^:]++:[^@])[^@]*+@""",
    r"""(?:SELECT|INSERT|UPDATE|DELETE).*%s.*%""":
        rf"""\A(?>.*?{_SQL_VERB})(?>.*?%s).*?%""",
    r"""\.format\s*\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)""":
        rf"""\A(?>.*?\.format\s*+\()(?>.*?\)).*?{_SQL_VERB}""",
    r"""(?:SELECT|INSERT|UPDATE|DELETE).*\.format\s*\(""":
        rf"""\A(?>.*?{_SQL_VERB}).*?\.format\s*+\(""",
    r"""(?:execute|cursor\.execute)\s*\(\s*["']?\s*(?:SELECT|INSERT|UPDATE|DELETE).*\+""":
        rf"""\A(?>.*?execute\s*+\(\s*+(?:["']\s*+)?+{_SQL_VERB}).*?\+""",
    r"""subprocess\.call\s*\([^)]*shell\s*=\s*True""":
        _BETWEEN.format(call=r"subprocess\.call", option="shell"),
    r"""subprocess\.Popen\s*\([^)]*shell\s*=\s*True""":
        _BETWEEN.format(call=r"subprocess\.Popen", option="shell"),
    r"""subprocess\.run\s*\([^)]*shell\s*=\s*True""":
        _BETWEEN.format(call=r"subprocess\.run", option="shell"),
    r"""app\.run\s*\([^)]*debug\s*=\s*True""":
        _BETWEEN.format(call=r"app\.run", option="debug"),
    r"""os\.path\.join\s*\(\s*[^,]+,\s*(?:request|user_input)""":
        r"""os\.path\.join\s*+\([^,]++,\s*+(?:request|user_input)""",
}

# Weights of the risk score, its bounds, and the bands of the risk level.
SCORE_WEIGHTS: dict[str, int] = {
    "non_existent_package": 20,
    "typosquat_risk": 15,
    "critical_security": 15,
    "high_security": 10,
    "medium_security": 5,
    "low_security": 2,
    "hallucinated_api": 10,
}
MAX_RISK_SCORE = 100
RISK_BANDS: tuple[tuple[int, str, str], ...] = (
    (80, "🔴", "Critical"),
    (50, "🟠", "High"),
    (20, "🟡", "Medium"),
    (0, "🟢", "Low"),
)
SEVERITY_RANK: dict[str, int] = {"critical": 0, "high": 1, "medium": 2, "low": 3}
UNKNOWN_SEVERITY_RANK = 4
SEVERITY_BADGES: dict[str, str] = {
    "critical": "🔴",
    "high": "🟠",
    "medium": "🟡",
    "low": "🟢",
}
UNKNOWN_SEVERITY_BADGE = "⚪"

# Names that typosquats imitate, in list order.
POPULAR_PACKAGES: tuple[str, ...] = (
    "requests", "flask", "django", "numpy", "pandas", "tensorflow", "torch",
    "transformers", "openai", "langchain", "fastapi", "sqlalchemy", "boto3", "pillow",
    "scikit-learn", "beautifulsoup4", "celery", "redis", "pytest", "httpx", "pydantic",
    "uvicorn", "gunicorn", "aiohttp", "cryptography",
)
MAX_TYPO_DISTANCE = 2
NEW_PACKAGE_DAYS = 30

# Public names per module, 21 modules with 730 names. Another table comes in as
# a parameter (see ``known_api_table``).
KNOWN_APIS: dict[str, tuple[str, ...]] = {
    "requests": (
        "get", "post", "put", "delete", "patch", "head", "options", "request", "Session",
        "Response", "PreparedRequest", "Request", "HTTPError", "ConnectionError", "Timeout",
        "URLRequired", "TooManyRedirects", "RequestException", "codes", "auth", "cookies",
        "exceptions", "hooks", "models", "sessions", "structures", "utils", "adapters", "packages",
        "compat", "api",
    ),
    "httpx": (
        "get", "post", "put", "delete", "patch", "head", "options", "request", "stream", "Client",
        "AsyncClient", "Response", "Request", "URL", "Headers", "QueryParams", "Cookies",
        "Timeout", "Limits", "HTTPError", "RequestError", "HTTPStatusError", "TimeoutException",
        "ConnectError", "BasicAuth", "DigestAuth", "codes",
    ),
    "flask": (
        "Flask", "render_template", "render_template_string", "redirect", "url_for", "request",
        "jsonify", "Blueprint", "make_response", "abort", "flash", "get_flashed_messages",
        "session", "g", "current_app", "send_file", "send_from_directory", "Response", "Request",
        "after_this_request", "has_request_context", "has_app_context", "cli", "Config", "testing",
        "templating", "signals", "json", "wrappers",
    ),
    "fastapi": (
        "FastAPI", "APIRouter", "Depends", "Query", "Path", "Body", "Header", "Cookie", "Form",
        "File", "UploadFile", "HTTPException", "Request", "Response", "WebSocket",
        "BackgroundTasks", "Security", "status", "encoders", "middleware", "params", "routing",
        "staticfiles", "templating", "testclient", "responses", "security",
    ),
    "django": (
        "setup", "conf", "urls", "views", "http", "db", "forms", "template", "test", "utils",
        "core", "contrib", "middleware", "dispatch", "shortcuts",
    ),
    "openai": (
        "OpenAI", "AsyncOpenAI", "AzureOpenAI", "AsyncAzureOpenAI", "ChatCompletion", "Completion",
        "Client", "api_key", "api_base", "api_type", "api_version", "Embedding", "Image", "Audio",
        "Moderation", "Model", "File", "FineTune", "FineTuning", "error", "resources", "types",
        "BadRequestError", "AuthenticationError", "PermissionDeniedError", "NotFoundError",
        "APIConnectionError", "RateLimitError", "APIStatusError",
    ),
    "langchain": (
        "LLMChain", "ConversationChain", "SequentialChain", "SimpleSequentialChain",
        "TransformChain", "RetrievalQA", "VectorDBQA", "PromptTemplate", "ChatPromptTemplate",
        "FewShotPromptTemplate", "LLM", "ChatOpenAI", "OpenAI", "agents", "callbacks", "chains",
        "chat_models", "document_loaders", "embeddings", "llms", "memory", "output_parsers",
        "prompts", "retrievers", "schema", "text_splitter", "tools", "utilities", "vectorstores",
    ),
    "transformers": (
        "AutoModel", "AutoModelForCausalLM", "AutoModelForSequenceClassification",
        "AutoModelForTokenClassification", "AutoModelForQuestionAnswering",
        "AutoModelForSeq2SeqLM", "AutoModelForMaskedLM", "AutoTokenizer", "AutoConfig",
        "AutoFeatureExtractor", "AutoProcessor", "AutoImageProcessor", "pipeline", "Pipeline",
        "Trainer", "TrainingArguments", "BertModel", "BertTokenizer", "BertConfig", "GPT2Model",
        "GPT2Tokenizer", "GPT2Config", "T5Model", "T5Tokenizer", "T5Config", "RobertaModel",
        "RobertaTokenizer", "set_seed", "logging", "PreTrainedModel", "PreTrainedTokenizer",
        "PretrainedConfig", "BatchEncoding", "DataCollatorWithPadding",
        "DataCollatorForLanguageModeling", "GenerationConfig", "StoppingCriteria",
    ),
    "torch": (
        "tensor", "Tensor", "zeros", "ones", "rand", "randn", "randint", "arange", "linspace",
        "logspace", "eye", "empty", "full", "cat", "stack", "split", "chunk", "squeeze",
        "unsqueeze", "reshape", "flatten", "transpose", "permute", "contiguous", "clone", "detach",
        "no_grad", "enable_grad", "set_grad_enabled", "save", "load", "manual_seed", "nn", "optim",
        "utils", "cuda", "backends", "autograd", "jit", "onnx", "distributed", "functional", "hub",
        "amp", "float16", "float32", "float64", "int8", "int16", "int32", "int64", "bool",
        "complex64", "complex128", "device", "dtype", "is_tensor", "sigmoid", "relu", "softmax",
        "tanh", "matmul", "mm", "bmm", "dot", "einsum", "sum", "mean", "max", "min", "abs", "sqrt",
        "exp", "log", "clamp", "clip", "where", "topk", "sort", "argmax", "argmin", "pow", "norm",
    ),
    "tensorflow": (
        "constant", "Variable", "function", "GradientTape", "Module", "keras", "data",
        "distribute", "saved_model", "lite", "summary", "math", "linalg", "signal", "image", "io",
        "strings", "debugging", "config", "nest", "ragged", "zeros", "ones", "fill", "eye",
        "range", "cast", "reshape", "transpose", "expand_dims", "squeeze", "concat", "stack",
        "split", "tile", "gather", "reduce_sum", "reduce_mean", "reduce_max", "reduce_min",
        "matmul", "tensordot", "float16", "float32", "float64", "int32", "int64", "bool", "string",
        "TensorSpec", "RaggedTensor", "SparseTensor", "nn", "train", "estimator", "feature_column",
    ),
    "numpy": (
        "array", "ndarray", "zeros", "ones", "empty", "full", "arange", "linspace", "logspace",
        "eye", "identity", "meshgrid", "mgrid", "ogrid", "concatenate", "stack", "vstack",
        "hstack", "dstack", "split", "hsplit", "vsplit", "reshape", "ravel", "flatten",
        "transpose", "swapaxes", "expand_dims", "squeeze", "sum", "mean", "std", "var", "min",
        "max", "argmin", "argmax", "cumsum", "cumprod", "dot", "matmul", "inner", "outer", "cross",
        "einsum", "linalg", "random", "fft", "sin", "cos", "tan", "exp", "log", "log2", "log10",
        "sqrt", "abs", "sign", "ceil", "floor", "round", "clip", "where", "select", "sort",
        "argsort", "unique", "searchsorted", "save", "load", "savez", "loadtxt", "savetxt",
        "genfromtxt", "float16", "float32", "float64", "int8", "int16", "int32", "int64", "bool_",
        "complex64", "complex128", "inf", "nan", "pi", "e", "newaxis", "dtype", "isnan", "isinf",
        "isfinite", "allclose", "array_equal", "testing",
    ),
    "pandas": (
        "DataFrame", "Series", "Index", "MultiIndex", "Categorical", "CategoricalIndex",
        "DatetimeIndex", "TimedeltaIndex", "PeriodIndex", "Timestamp", "Timedelta", "Period",
        "read_csv", "read_excel", "read_json", "read_sql", "read_parquet", "read_feather",
        "read_hdf", "read_pickle", "read_html", "read_clipboard", "read_table", "read_fwf",
        "read_gbq", "concat", "merge", "melt", "pivot", "pivot_table", "crosstab", "cut", "qcut",
        "get_dummies", "to_datetime", "to_timedelta", "to_numeric", "date_range", "period_range",
        "timedelta_range", "isna", "isnull", "notna", "notnull", "set_option", "get_option",
        "reset_option", "option_context", "options", "testing", "NA", "NaT", "api", "io", "errors",
        "Grouper", "NamedAgg",
    ),
    "sqlalchemy": (
        "create_engine", "engine", "text", "select", "insert", "update", "delete", "and_", "or_",
        "not_", "func", "Column", "Integer", "String", "Float", "Boolean", "DateTime", "Date",
        "Text", "ForeignKey", "Table", "MetaData", "inspect", "event", "Session", "sessionmaker",
        "scoped_session", "declarative_base", "relationship", "backref", "orm", "exc", "pool",
        "types", "schema",
    ),
    "boto3": (
        "client", "resource", "Session", "set_stream_logger", "setup_default_session",
        "NullHandler", "utils", "exceptions", "docs", "resources", "session",
    ),
    "sklearn": (
        "base", "calibration", "cluster", "compose", "covariance", "cross_decomposition",
        "datasets", "decomposition", "discriminant_analysis", "dummy", "ensemble", "exceptions",
        "experimental", "externals", "feature_extraction", "feature_selection", "gaussian_process",
        "impute", "inspection", "isotonic", "kernel_approximation", "kernel_ridge", "linear_model",
        "manifold", "metrics", "mixture", "model_selection", "multiclass", "multioutput",
        "naive_bayes", "neighbors", "neural_network", "pipeline", "preprocessing",
        "random_projection", "semi_supervised", "svm", "tree", "utils", "config_context",
        "get_config", "set_config", "show_versions",
    ),
    "pydantic": (
        "BaseModel", "Field", "validator", "root_validator", "BaseSettings", "ValidationError",
        "AnyUrl", "EmailStr", "HttpUrl", "SecretStr", "conint", "confloat", "constr", "conlist",
        "conset", "model_validator", "field_validator", "ConfigDict", "computed_field",
        "TypeAdapter", "PrivateAttr", "create_model",
    ),
    "celery": (
        "Celery", "Task", "chain", "group", "chord", "shared_task", "current_app", "current_task",
        "app", "beat", "bin", "canvas", "concurrency", "exceptions", "loaders", "platforms",
        "result", "schedules", "signals", "states", "utils", "worker",
    ),
    "redis": (
        "Redis", "StrictRedis", "ConnectionPool", "Sentinel", "SentinelConnectionPool",
        "RedisCluster", "ClusterConnectionPool", "from_url", "BlockingConnectionPool",
        "Connection", "SSLConnection", "ConnectionError", "TimeoutError", "RedisError",
        "AuthenticationError", "BusyLoadingError", "ResponseError", "DataError", "PubSubError",
        "client", "cluster", "commands", "exceptions", "sentinel", "utils",
    ),
    "pytest": (
        "fixture", "mark", "param", "raises", "warns", "skip", "xfail", "fail", "exit",
        "importorskip", "approx", "deprecated_call", "MonkeyPatch", "TempdirFactory",
        "TempPathFactory", "LogCaptureFixture", "CaptureFixture", "main",
        "register_assert_rewrite", "freeze_includes", "Item", "Collector", "Session", "Module",
        "Class", "Function",
    ),
    "PIL": (
        "Image", "ImageDraw", "ImageFont", "ImageFilter", "ImageEnhance", "ImageOps", "ImageColor",
        "ImageChops", "ImageStat", "ImageFile", "ImageSequence", "ImagePalette", "ImagePath",
        "ImageTransform", "ImageMath", "ImageGrab", "ExifTags", "TiffTags", "TiffImagePlugin",
        "PngImagePlugin", "JpegImagePlugin", "GifImagePlugin", "BmpImagePlugin",
        "UnidentifiedImageError",
    ),
    "pillow": (
        "Image", "ImageDraw", "ImageFont", "ImageFilter", "ImageEnhance", "ImageOps",
    ),
}


def known_api_table(spark: SparkSession, apis: DataFrame | dict | None = None) -> DataFrame:
    """The ``(module, name)`` table of public names.

    ``apis`` is a table with these columns or a dict of module to names; by default
    ``KNOWN_APIS``.
    """
    if apis is None:
        apis = KNOWN_APIS
    if not isinstance(apis, DataFrame):
        rows = [(m, n) for m, names in apis.items() for n in names]
        apis = spark.createDataFrame(rows, "module string, name string")
    return apis.select("module", "name")


def popular_table(spark: SparkSession, names=POPULAR_PACKAGES) -> DataFrame:
    """The ``(name, ord)`` table of well-known packages."""
    return spark.createDataFrame(list(zip(names, range(len(names)))), "name string, ord int")


def security_rules_table(spark: SparkSession, rules=SECURITY_RULES) -> DataFrame:
    """The rule set as a table, one row per category."""
    return spark.createDataFrame(
        [
            (r.category, i, r.severity, r.description, list(r.patterns))
            for i, r in enumerate(rules)
        ],
        "category string, category_ord int, severity string, description string, "
        "patterns array<string>",
    )


def rules_from_table(table: DataFrame) -> tuple[SecurityRule, ...]:
    """Read a caller's rule table (some dozens of rows by nature) into plan-time rules."""
    rows = table.orderBy("category_ord").collect()
    return tuple(
        SecurityRule(r.category, r.severity, r.description, tuple(r.patterns)) for r in rows
    )


_GROUP = re.compile(r"(?<!\\)((?:\\\\)*)(?:\(\?P<(\w+)>|\(\?P=(\w+)\)|(\\Z))")


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's syntax, which writes named groups and the end otherwise."""
    numbers: dict[str, int] = {}

    def written(found: re.Match) -> str:
        if found[4]:
            return found[1] + r"\z"
        number = numbers.setdefault(found[2] or found[3], len(numbers))
        return found[1] + (f"(?<g{number}>" if found[2] else rf"\k<g{number}>")

    return _GROUP.sub(written, pattern)


def _in_python(pattern: str) -> bool:
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error as error:
        warnings.warn(f"pattern {pattern!r} does not compile and is skipped: {error}")
        return False
    return True


def valid_rules(spark: SparkSession, rules) -> tuple[SecurityRule, ...]:
    """The rules as Spark runs them. Patterns that are not valid in Python are dropped, and
    categories left without any; one that Spark cannot run raises ``ValueError``."""
    if rules is SECURITY_RULES:
        return rules
    kept = []
    for rule in rules:
        good = [i for i, p in enumerate(rule.patterns) if _in_python(p)]
        if good:
            kept.append(
                SecurityRule(
                    rule.category,
                    rule.severity,
                    rule.description,
                    tuple(java_pattern(rule.patterns[i]) for i in good),
                    tuple(rule.needles_of(i) or needed_literals(rule.patterns[i]) for i in good),
                )
            )
    written = [(ignore_case(p),) for rule in kept for p in rule.patterns]
    try:
        # As rows, so that the plan stays small whatever the number of patterns.
        spark.createDataFrame(written, "pattern string").select(F.rlike(F.lit(""), "pattern")).collect()
    except Exception as error:  # Spark wraps what the regex engine raises
        raise ValueError(f"a pattern cannot be run: {error}") from error
    return tuple(kept)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
