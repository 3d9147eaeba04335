"""Explicit schemas: empty lists in a file must not decide a column's type."""

UNITS = "work string, i int, m string, cn array<string>, ko array<string>, nt array<string>, h string, x int, c int"
REGISTRY_ENTRY = (
    "id string, title_cn string, title_ko string, author_cn string, author_ko string, dynasty string, canon string, canon_id string, canon_vol int, canon_no int, "
    "canon_label string, canon_full string, canon_ko string, collection string, tags array<string>, verify boolean, source string, note string"
)
RIGHTS = "map<string,struct<name:string,org:string,url:string,license:string,redistribute:string,condition:string,ok:boolean>>"
REGISTRY = f"version string, works array<struct<{REGISTRY_ENTRY.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(' boolean', ':boolean')}>>"
UNIT = "struct<i:int,m:string,cn:array<string>,ko:array<string>,nt:array<string>,h:string,x:int,c:int>"
WORK = (
    "meta map<string,string>, glossary array<struct<cn:string,ko:string,note:string>>, front array<string>, "
    f"chapters array<struct<t:string,i:int>>, sections array<struct<lv:int,t:string,i:int>>, units array<{UNIT}>, _corrupt_record string"
)
PARAGRAPHS = "path string, pos int, text string, style string"
TABLES = "path string, t int, rows array<array<string>>"


def unused(df, stem: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
