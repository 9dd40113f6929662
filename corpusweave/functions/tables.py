"""Role words, framework patterns, languages by extension. They are stated as they must be for equal results."""

# A role and the path or name words that give it.
ROLES = {
    "test": ("test", "tests", "spec", "fixture", "mock"),
    "service": ("service", "services"),
    "controller": ("controller", "controllers"),
    "handler": ("handler", "handlers", "endpoint"),
    "repository": ("repository", "repositories", "repo"),
    "dto": ("dto", "request", "response"),
    "entity": ("entity", "entities", "model"),
    "domain": ("domain",),
    "application": ("application", "app"),
    "infrastructure": ("infrastructure", "infra"),
    "api": ("api", "http"),
    "web": ("web", "frontend", "ui"),
    "command": ("command", "commands"),
    "query": ("query", "queries"),
    "event": ("event", "events"),
    "validator": ("validator", "validation"),
    "config": ("config", "configuration", "settings"),
    "migration": ("migration", "migrations"),
}

# By language, a framework and the import substrings that give it.
IMPORT_FRAMEWORKS = {
    "csharp": {
        "xunit": ("xunit",), "nunit": ("nunit",), "mstest": ("microsoft.visualstudio.testtools.unittesting",),
        "efcore": ("microsoft.entityframeworkcore", "entityframeworkcore"), "mediatr": ("mediatr",), "fluentvalidation": ("fluentvalidation",),
        "automapper": ("automapper",), "aspnetcore": ("microsoft.aspnetcore", "aspnetcore"), "serilog": ("serilog",), "dapper": ("dapper",),
        "hangfire": ("hangfire",), "masstransit": ("masstransit",),
    },
    "go": {
        "gin": ("github.com/gin-gonic/gin",), "echo": ("github.com/labstack/echo",), "fiber": ("github.com/gofiber/fiber",), "chi": ("github.com/go-chi/chi",),
        "grpc": ("google.golang.org/grpc", "grpc"), "gorm": ("gorm.io/gorm", "gorm.io"), "sqlx": ("github.com/jmoiron/sqlx",), "cobra": ("github.com/spf13/cobra",),
        "viper": ("github.com/spf13/viper",), "testify": ("github.com/stretchr/testify",), "gqlgen": ("github.com/99designs/gqlgen",),
        "protobuf": ("google.golang.org/protobuf", "github.com/golang/protobuf"),
    },
    "javascript": {
        "react": ("react",), "nextjs": ("next", "nextjs"), "express": ("express",), "nestjs": ("@nestjs",), "jest": ("jest", "@jest"), "vitest": ("vitest",),
        "playwright": ("playwright", "@playwright"), "cypress": ("cypress",), "prisma": ("prisma", "@prisma"), "mongoose": ("mongoose",),
        "redux": ("redux", "@reduxjs/toolkit"), "vue": ("vue",), "nuxt": ("nuxt",),
    },
    "python": {
        "django": ("django",), "flask": ("flask",), "fastapi": ("fastapi",), "pytest": ("pytest",), "sqlalchemy": ("sqlalchemy",), "pydantic": ("pydantic",),
        "pandas": ("pandas",), "numpy": ("numpy",), "celery": ("celery",), "requests": ("requests",),
    },
    "php": {
        "laravel": ("illuminate", "laravel"), "symfony": ("symfony",), "phpunit": ("phpunit",), "doctrine": ("doctrine",), "livewire": ("livewire",), "pest": ("pest",),
    },
}
IMPORT_FRAMEWORKS["typescript"] = IMPORT_FRAMEWORKS["javascript"]

# Words that give a framework in free text beside its own name.
FREE_WORDS = {"efcore": ("entity framework",), "aspnetcore": ("asp.net core",), "nextjs": ("next.js",), "nestjs": ("nest.js",)}
#: Every framework by its own name, and by those words.
FREE_FRAMEWORKS = {t: (t, *FREE_WORDS.get(t, ())) for by in IMPORT_FRAMEWORKS.values() for t in by}

# Test frameworks, first match wins.
TEST_FRAMEWORKS = ("xunit", "nunit", "mstest", "jest", "vitest", "playwright", "cypress", "pytest", "phpunit", "pest", "testify")

# Languages and kinds by extension.
LANGUAGES = {"go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "php": "php", "cs": "csharp", "py": "python"}
LABELS = {"xaml": "xml", "xml": "xml", "csproj": "xml", "fsproj": "xml", "sln": "xml", "md": "markdown", "markdown": "markdown", **{k: v for k, v in LANGUAGES.items() if k not in ("mjs", "cjs")}}
CODE = ("go", "js", "jsx", "ts", "tsx", "php", "cs", "py")
DOCUMENTS = ("pdf", "md", "txt", "csv", "xls", "xlsx", "doc", "docx")

# Common function words of six languages, our own short selection; a stop-word file adds to it.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were will with "
    "el los las un una y o de del que en por para con no se su al lo como es "
    "os uma e do da em com nao um dos das mais ao "
    "der die das und ist nicht ein eine zu den von mit im dem auf sich des "
    "le les et est pas une dans pour sur qui ne ce au du "
    "il di che la per non gli della sono nel".split()
)
