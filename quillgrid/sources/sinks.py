"""Writers: the multi-page CSV report, plain CSV, and WebDAV as a Python data source."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def report_lines(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Lines of the report: per page "Seite N", the labels, the rows, a blank line; (page, part, row, line).

    ``pages`` has page (0-based), row and one column per label; the images of a cell are not part of it.
    """
    plain = lambda c: F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda cells: F.concat_ws(";", *cells)
    each = pages.select("page").distinct()
    none = F.lit(0)
    head = each.select("page", F.lit(0).alias("part"), none.alias("row"), F.concat(F.lit("Seite "), (F.col("page") + 1).cast("string")).alias("line"))
    names = each.select("page", F.lit(1), none, line([plain(F.lit(x)) for x in labels]))
    rows = pages.select("page", F.lit(2), "row", line([plain(F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(""))) for x in labels]))
    return head.union(names).union(rows).union(each.select("page", F.lit(3), none, F.lit("")))


def write_report(pages: DataFrame, labels: list[str], path: str) -> None:
    """One text file with CRLF line ends and a byte order mark; pages are sorted, not collected."""
    least = pages.agg(F.min("page").alias("__first"))
    first = (F.col("page") == F.col("__first")) & (F.col("part") == 0)
    marked = report_lines(pages, labels).join(F.broadcast(least), F.lit(True), "left")
    ordered = marked.withColumn("line", F.when(first, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")))
    ordered.coalesce(1).sortWithinPartitions("page", "part", "row").select("line").write.option("lineSep", "\r\n").text(path)


def write_plain_csv(cells: DataFrame, value: str, path: str) -> None:
    """The older report: page (from 1), row and one value column named ``value``, in order of page and row."""
    rows = cells.select((F.col("page") + 1).alias("Seite"), F.col("row").alias("Zeile"), F.coalesce("text", F.lit("")).alias(value))
    rows.repartitionByRange("Seite", "Zeile").sortWithinPartitions("Seite", "Zeile").write.option("header", True).option("emptyValue", "").csv(path)


@dataclass(frozen=True)
class WebDavConfig:
    url: str
    user: str
    password: str
    folder: str

    @staticmethod
    def from_options(options: dict[str, str]) -> WebDavConfig | None:
        """None unless all of url, user and password are set; the folder gets a leading slash."""
        url, user, password = (options.get(k, "").strip() for k in ("url", "user", "password"))
        if not (url and user and password):
            return None
        return WebDavConfig(url.rstrip("/"), user, password, "/" + options.get("folder", "").strip("/"))


def http_request(config: WebDavConfig, method: str, path: str, body: bytes = b"") -> int:
    import base64
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    token = base64.b64encode(f"{config.user}:{config.password}".encode()).decode()
    request = Request(config.url + quote(path), data=body, method=method, headers={"Authorization": f"Basic {token}"})
    try:
        with urlopen(request, timeout=60) as answer:
            return answer.status
    except HTTPError as e:
        return e.code


def put_file(config: WebDavConfig, path: str, body: bytes, send=http_request) -> None:
    """Make the folders (201 and 405 are fine), then store the file (200, 201 and 204 are fine)."""
    at = ""
    for part in (config.folder.strip("/") + "/" + path).strip("/").split("/")[:-1]:
        at += "/" + part
        if (status := send(config, "MKCOL", at)) not in (201, 405):
            raise OSError(f"MKCOL {at}: {status}")
    target = f"{config.folder.rstrip('/')}/{path}"
    if (status := send(config, "PUT", target, body)) not in (200, 201, 204):
        raise OSError(f"PUT {target}: {status}")


def probe(config: WebDavConfig | None, send=http_request) -> tuple[bool, str]:
    if config is None:
        return False, "not configured"
    try:
        status = send(config, "PROPFIND", config.folder)
    except OSError as e:
        return False, str(e)
    return status in (200, 207), f"status {status}"


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def write(self, rows) -> WriterCommitMessage:
        config = WebDavConfig.from_options(self.options)
        if config is None:
            raise ValueError("url, user and password are needed")
        for row in rows:
            put_file(config, row["path"], bytes(row["content"]))
        return WriterCommitMessage()


class WebDav(DataSource):
    """``df.select("path", "content").write.format("webdav").options(url=..., user=..., password=..., folder=...)``."""

    @classmethod
    def name(cls) -> str:
        return "webdav"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))
