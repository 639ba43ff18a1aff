"""Small inline tables for operators that need code, secrets, requests or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHUNK_COLUMNS = "chunk_id string, file_path string, language string, symbol_name string, symbol_type string, start_line int, end_line int, content string, context_header string, docstring string, dependencies array<string>"
CHUNKS = [
    ("c01", "shop/cart.py", "python", "Cart", "class", 1, 6, "class Cart:\n    items = []", "class Cart", "A basket of items.", []),
    ("c02", "shop/cart.py", "python", "add_item", "method", 8, 15, "def add_item(self, item):\n    check_stock(item)\n    self.items.append(item)", "class Cart > def add_item(self, item)", None, []),
    ("c03", "shop/cart.py", "python", "total_price", "method", 17, 24, "def total_price(self):\n    return apply_tax(sum(self.items))", "class Cart > def total_price(self)", "The price with tax.", []),
    ("c04", "shop/tax.py", "python", "apply_tax", "function", 1, 5, "def apply_tax(amount):\n    return amount * rate()", "def apply_tax(amount)", "Adds the tax.", []),
    ("c05", "shop/tax.py", "python", "rate", "function", 7, 9, "def rate():\n    return 1.2", "def rate()", None, []),
    ("c06", "stock/check.go", "go", "check_stock", "function", 3, 12, "func check_stock(item string) bool {\n  return lookup(item)\n}", "Go function: check_stock", None, []),
    ("c07", "stock/check.go", "go", "lookup", "function", 14, 20, "func lookup(item string) bool {\n  return true\n}", "Go function: lookup", None, []),
    ("c08", "web/api.ts", "typescript", "Handler", "interface", 1, 4, "export interface Handler {\n  run(): void\n}", "Typescript interface: Handler", None, []),
    ("c09", "web/api.ts", "typescript", "apply_tax", "function", 6, 10, "export function apply_tax(x) {\n  return Handler\n}", "Typescript function: apply_tax", None, ["rate"]),
    ("c10", "web/api.ts", "typescript", "api_L12", "block", 12, 16, "const a = 1\nconst b = 2\nconst c = 3", "web/api.ts:L12-L16", None, []),
    ("c11", "notes/readme.md", "markdown", "Intro", "block", 1, 9, "# Intro\nHow the cart works", "Markdown section: # Intro", None, []),
    ("c12", "shop/cart.py", "python", None, "module", 26, 30, "if __name__ == '__main__':\n    print(total_price)", None, None, []),
    ("c13", "shop/cart.py", "python", "block_L31", "block", 31, 34, "x = 1\ny = 2\nz = 3", None, None, []),
]
QUERY_COLUMNS = "query_id int, query string"
QUERIES = [
    (1, "where is the UI rendered"), (2, "how does apply tax work"), (3, "database config error"), (4, "cart total_price"), (5, "auth token session for the api"),
    (6, "the of and"), (7, ""), (8, "checkStock HTTPServer parse_URL"), (9, "server host port"), (10, "Ünïcode größe naïve"),
]
_KEY = "A1b2C3d4E5f6G7h8I9j0"
SECRET_COLUMNS = "id int, raw string"
SECRETS = [
    (1, "key = sk-" + "ant-" + _KEY), (2, "use sk-" + "proj-" + _KEY + " now"), (3, "gh" + "p_" + "a1B2" * 9), (4, "github" + "_pat_" + "a1B2_" * 9), (5, "gh" + "o_" + "z9Y8" * 9),
    (6, "AK" + "IA" + "ABCDEFGH12345678 and text"), (7, "xo" + "xb-" + "1234567890abc"), (8, "-----BEGIN RSA PRIVATE" + " KEY-----\nabc\ndef\n-----END RSA PRIVATE" + " KEY-----\ntail"),
    (9, "postgres" + "://user:" + "hunter2@db.local/x"), (10, "MYSQL" + "://u:" + "p@h and mongodb+srv" + "://a:b" + "@c"), (11, "nothing here"), (12, ""),
]
LABEL_COLUMNS = "id int, label string"
LABELS = [(1, "parse_url"), (2, "🚀 launch!"), (3, "a  b\tc"), (4, "operator<<"), (5, "naïve(x)"), (6, "***"), (7, "List<String>.of"), (8, "x-y.z_1()")]
URL_COLUMNS = "id int, url string"
URLS = [
    (1, "https://github.com/owner/repo.git"), (2, "owner/repo"), (3, "github.com/owner/repo/"), (4, "file:///etc/passwd"), (5, "-x/repo"), (6, "https://example.com/owner/repo"),
    (7, "http://www.github.com/a.b/c_d-e"), (8, "  owner/repo.git  "), (9, "ssh://github.com/a/b"), (10, "owner"), (11, "owner/-repo"), (12, ""),
]
REQUEST_COLUMNS = "request_id int, file_path string, line int, symbol string"
REQUESTS = [
    (1, "shop/cart.py", 8, None), (2, "shop/tax.py", 0, None), (3, "stock/check.go", 12, None), (4, None, None, "APPLY_TAX"), (5, None, None, "check_stock"), (6, None, None, "nobody"),
    (7, None, None, "rate"), (8, "web/api.ts", 99, "Handler"), (9, "shop/cart.py", 0, "lookup"),
]
FILE_COLUMNS = "file_path string, text string"
PY = '"""Shop helpers.\n\nTwo lines."""\nimport os\nfrom shop.tax import rate\n\nLIMIT = 3\nNAMES = []\nOPEN = True\n\n\nclass Cart(dict):\n    """A basket."""\n\n    size = 0\n\n    def add(self, item: str) -> None:\n        """Adds."""\n        self.size += 1\n\n    async def send(self):\n        return rate()\n\n    class Inner:\n        pass\n\n\n@cache\ndef total(a, b=1):\n    return a + b\n\n\nasync def fetch(url):\n    return url\n'
GO = 'package main\n\nimport "fmt"\nimport "os"\nimport "io"\n\ntype Cart struct {\n  size int\n}\n\nfunc (c *Cart) Add(x int) {\n  if x > 0 {\n    c.size += x\n  }\n}\n\nfunc main() {\n  fmt.Println("x")\n}\n'
MD = "before\n\n# One\ntext a\ntext b\n\n## Two parts of a rather long heading here\ntext c\n"
FILES = [
    ("shop/cart.py", PY), ("bad/broken.py", "def f(:\n  x\n" + "y = 1\n" * 80), ("cmd/main.go", GO), ("docs/a.md", MD), ("docs/b.md", "plain\ntext\n"), ("data/long.yaml", "".join(f"k{i}: {i}\n" for i in range(141))),
    ("data/w75.txt", "x\n" * 75), ("data/w76.txt", "x\n" * 76), ("empty.py", ""), ("blank.txt", "\n \n\t\n"), ("crlf.css", "a {\r\n b: c\r\n}\r\n"), ("tiny.py", "x = 1\n"),
]


def frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def chunks(spark: SparkSession) -> DataFrame:
    return frame(spark, CHUNKS, CHUNK_COLUMNS)


def files(spark: SparkSession) -> DataFrame:
    return frame(spark, FILES, FILE_COLUMNS)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "CAST([" + ", ".join(map(_literal, v)) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str, name: str) -> str:
    """A common table expression with the same rows for SQL."""
    fields = [c.split() for c in columns.split(", ")]
    kinds = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "array<string>": "VARCHAR[]"}
    inner = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT " + ", ".join(f"CAST({f} AS {kinds[k]}) AS {f}" for f, k in fields) + f" FROM (VALUES {inner}) v(" + ", ".join(f for f, _ in fields) + "))"
