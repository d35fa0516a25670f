"""python -m lectern: books of a folder to summaries, once or as they come.

Exit codes: 0 done, 1 an error (of a book or of the run), 75 the model is busy (try again later), 130 interrupted.
"""

from __future__ import annotations

import argparse
import contextlib
import fcntl
import logging
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.client import HttpClient
from .plans.flow import Flow
from .plans.model import LecternError, ModelBusy, StubClient
from .plans.stages import STEPS, StageStore, load, save
from .render import epub, pages
from .session import session, ship
from .sources import books as bk
from .sources import config as cf
from .streaming.watch import watch

log = logging.getLogger("lectern")


@contextlib.contextmanager
def single_instance(path: Path) -> Iterator[None]:
    """One run at a time: the lock goes with the process that holds it."""
    with path.open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise LecternError("another run is at work here") from e
        yield


def preflight(config: dict, root: Path) -> tuple[Path, Path]:
    """The input and the output folder; an error if one can't be read or written."""
    source, target = cf.folders(config, root)
    probe = target / ".writable"
    try:
        next(source.iterdir(), None)
        probe.write_text("")
        probe.unlink()
    except OSError as e:
        raise LecternError(f"{e.filename}: {e.strerror}") from e
    return source, target


def process(spark: SparkSession, files: DataFrame, work: str, output: str, config: dict, client, *, force: bool = False, since: str | None = None, style: str = "") -> int:
    """Summaries of files (path, content) as pages and EPUBs in output; the number of books that failed."""
    key = F.sha2("path", 256).alias("book_id")
    for name, df in zip(("books", "pages", "headings"), bk.load_books(files), strict=True):  # files are read once
        save(df.select(key, *df.columns), f"{work}/loaded/{name}")
    found, marks, heads = (load(spark, f"{work}/loaded/{name}") for name in ("books", "pages", "headings"))
    store = StageStore(spark, work)
    if force or since:
        for r in found.select("book_id").collect():  # the books of one run
            store.reset("chunk" if force else since, r.book_id)
    bad = found.where("error is not null").select("path", "error").collect()
    for r in bad:
        log.error("%s: %s", r.path, r.error)
    flow = Flow(spark, work, client, style=style, max_minutes=config["max_minutes"], chunk_tokens=config["chunk_tokens"], context=config["context_length"], output=config["max_output_tokens"], parallel=config["parallel"], threshold=config["quote_match_threshold"])
    done, failed = flow.run(found.where("error is null"), heads, marks)
    done = done.persist()
    for name in pages.write_pages(pages.render_books(done).select("name", "html"), output):
        log.info("wrote %s", name)
    for r in epub.epub_books(done).join(found.select("book_id", "title"), "book_id").toLocalIterator():  # one file at a time
        if r.error:
            log.warning("%s: no EPUB: %s", r.title, r.error)
        else:
            name = spark.range(1).select(pages.fx.epub_name(F.lit(r.title))).first()[0]
            (Path(output) / name).write_bytes(r.content)
    lost = failed.collect()
    for r in lost:
        log.error("%s, %s: %s", r.book_id, r.step, r.error)
    done.unpersist()
    return len(bad) + len({r.book_id for r in lost})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lectern", description="Verified summaries of long documents")
    parser.add_argument("command", choices=["book", "watch", "preflight"])
    parser.add_argument("name", nargs="?", help="a path, a file name or a part of one; all books if left out")
    parser.add_argument("--config", default="config.json")
    parser.add_argument("--model-url", help="where the model answers; a stub that needs no model if left out")
    parser.add_argument("--force", action="store_true", help="begin anew")
    parser.add_argument("--from", dest="since", choices=STEPS, help="repeat this step and those after it")
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        root = Path(args.config).resolve().parent
        config = cf.load_config(args.config)
        source, target = preflight(config, root)
        if args.command == "preflight":
            return 0
        client = (lambda: HttpClient(args.model_url, config["model"] or "", temperature=config["temperature"], timeout=config["request_timeout"])) if args.model_url else StubClient
        with single_instance(target / ".lock"):
            spark = session()
            ship(spark)
            work, style = str(root / "work"), cf.read_style(root / "style.md")
            if args.command == "watch":
                def step(ready: DataFrame) -> None:
                    files = bk.list_books(spark, str(source)).join(ready.select("path"), "path", "left_semi")
                    process(spark, files.select("path", "content"), work, str(target), config, client, style=style)

                watch(spark, str(source), f"{work}/seen", f"{work}/watch", step, f"{config['watch_interval']} seconds").awaitTermination()
                return 0
            listed = bk.list_books(spark, str(source))
            if args.name:
                listed = listed.where(F.col("path") == bk.find_book(listed, args.name))
            return min(1, process(spark, listed.select("path", "content"), work, str(target), config, client, force=args.force, since=args.since, style=style))
    except ModelBusy as e:
        log.error("%s", e)
        return 75
    except LecternError as e:
        log.error("%s", e)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
