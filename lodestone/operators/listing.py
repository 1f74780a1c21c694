"""The catalogue of a tenant's ready files: its text within a budget, and answers from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors, extension, strip

# Lines of the catalogue and of answers from it.
HEAD, FOLDERS, FILES = "已入库目录：%d 个文件夹，%d 个文件。", "[文件夹]", "[文件]"
OMITTED = "... 另有 %d 项因目录上下文长度限制未显示。"
EMPTY, NO_FILE, NO_FOLDER = "当前知识库还没有已完成入库的文件。", "没有在当前知识库的已入库文件中找到该文件。", "没有找到该文件夹中的已入库文件。"
FOUND, LISTED, EVERYWHERE = "找到了 **%d** 个匹配的已入库文件：", "%s中共有 **%d** 个已入库文件：", "知识库"
BUDGET = 12_000
LEAST_NAME = 3


def entries(docs: DataFrame) -> DataFrame:
    """Distinct kb, folder, path of ready files; those without a name have none."""
    name = strip(F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit("")))
    folder = F.btrim(F.replace(F.coalesce("folder", F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    named = docs.where("status = 'ready'").select("kb", folder.alias("folder"), name.alias("name")).where("name <> ''")
    return named.select("kb", "folder", F.when(F.col("folder") != "", F.concat_ws("/", "folder", "name")).otherwise(F.col("name")).alias("path")).distinct()


def _first(paths: DataFrame, kind: int, most: int) -> DataFrame:
    """The first paths of each tenant in order; more than `most` lines can't fit. Only so many rows of a tenant leave a task."""
    order = F.row_number().over(W.partitionBy("kb").orderBy(F.lower("path"), "path"))
    return paths.withColumn("at", order).where(F.col("at") <= most).select("kb", F.lit(kind).alias("kind"), "at", F.concat(F.lit("- "), "path").alias("line"))


def catalogue_text(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """kb, catalogue, omitted: the folders and then the files of each tenant in letter order, as many whole lines as the budget of characters holds, and a last line that counts the others. Tenants without ready files have no row."""
    files = entries(docs).select("kb", "path", "folder")
    folders = files.select("kb", "folder").distinct().select("kb", F.explode(ancestors(F.col("folder"))).alias("path")).distinct()
    counts = files.groupBy("kb").agg(F.count("*").alias("n_files")).join(folders.groupBy("kb").agg(F.count("*").alias("n_folders")), "kb", "left").fillna(0, ["n_folders"])
    most = budget // (len("- x") + 1) + 1
    between = counts.select("kb", F.lit(1).alias("kind"), F.lit(0).alias("at"), F.lit(FILES).alias("line"))
    lines = _first(folders, 0, most).union(between).union(_first(files, 2, most))
    ordered = W.partitionBy("kb").orderBy("kind", "at")
    head = F.format_string(HEAD, "n_folders", "n_files")
    total = F.col("n_folders") + 1 + F.col("n_files")
    own = lines.join(counts, "kb").withColumns({"n": F.row_number().over(ordered), "used": F.sum(F.length("line") + 1).over(ordered), "head": head, "total": total})
    base = F.length("head") + 1 + len(FOLDERS)
    fits = own.where(base + F.col("used") <= budget)
    # with lines left over, those that leave room for the count of the rest
    tail = F.when(F.col("n") < F.col("total"), 1 + F.length(F.format_string(OMITTED, F.col("total") - F.col("n")))).otherwise(0)
    room = base + F.col("used") + tail <= budget
    whole = fits.groupBy("kb").agg(F.max("n").alias("reached"), F.max(F.when(room, F.col("n"))).alias("kept"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("got"))
    shown = counts.join(whole, "kb", "left").select("kb", head.alias("head"), total.alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("got", F.array().cast("array<struct<n:int,line:string>>")).alias("got"))
    text = F.concat(F.array(F.col("head"), F.lit(FOLDERS)), F.transform(F.slice("got", 1, F.col("kept")), lambda x: x["line"]))
    left = F.col("total") - F.col("kept")
    text = F.when(left > 0, F.concat(text, F.array(F.format_string(OMITTED, left)))).otherwise(text)
    return shown.select("kb", F.array_join(text, "\n").alias("catalogue"), left.alias("omitted"))


def _mentions(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of messages (kb, said) with rows of names (kb, called) that occur in them. Messages are cut into pieces of the lengths that the tenant's names have, and these are joined by value: no message meets a name that it doesn't hold."""
    lengths = names.groupBy("kb").agg(F.collect_set(F.length("called")).alias("lengths"))
    sized = messages.join(lengths, "kb").withColumn("_l", F.explode("lengths")).where(F.col("_l") <= F.length("said"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("said") - F.col("_l") + 1), lambda i: F.substring(F.col("said"), i, F.col("_l"))))
    return sized.withColumn("called", F.explode(pieces)).drop("lengths", "_l", "said").join(names, ["kb", "called"]).drop("called").distinct()


def _plain(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\\"), F.lit("/")))


def _leaf(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def found_files(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id, kb, path of ready files whose name, of three characters or more, or path is in the question or the user's earlier messages. `questions` has question_id, kb, messages: texts, the question first, then the user's, newest first."""
    said = questions.select("question_id", "kb", _plain(F.array_join("messages", "\n")).alias("said"))
    files = entries(docs).select("kb", "path").where(F.length(_leaf(F.col("path"))) >= LEAST_NAME)
    names = files.select("kb", "path", F.explode(F.array_distinct(F.array(_leaf(F.col("path")), F.lower("path")))).alias("called"))
    return _mentions(said, names)


def asked_folders(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id, kb, target: the folders that the newest message with any names. Whole paths go before last names; a folder above another that is named goes."""
    said = questions.select("question_id", "kb", F.posexplode("messages").alias("age", "m")).select("question_id", "kb", "age", _plain(F.col("m")).alias("said"))
    folders = entries(docs).where("folder <> ''").select("kb", F.col("folder").alias("target")).distinct()
    names = folders.select("kb", "target", F.lit(0).alias("kind"), F.lower("target").alias("called")).union(folders.select("kb", "target", F.lit(1), _leaf(F.col("target"))))
    every = _mentions(said, names)
    best = every.groupBy("question_id", "kb").agg(F.min(F.struct("age", "kind")).alias("best"))
    named = every.join(best, ["question_id", "kb"]).where(F.struct("age", "kind") == F.col("best"))
    above = named.where("kind = 0").select("question_id", "kb", F.explode(F.filter(ancestors(F.col("target")), lambda x: x != F.col("target"))).alias("target")).distinct()
    return named.select("question_id", "kb", "target").join(above, ["question_id", "kb", "target"], "left_anti").unionByName(named.where("kind = 1").join(above, ["question_id", "kb", "target"], "left_semi").select("question_id", "kb", "target")).distinct()


def scoped_files(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id, kb, path of the ready files at or below the folders asked for; of all ready files of the tenant if none is named."""
    targets = asked_folders(questions, docs)
    files = entries(docs)
    below = files.withColumn("target", F.explode(ancestors(F.col("folder")))).join(targets, ["kb", "target"]).select("question_id", "kb", "path").distinct()
    free = questions.select("question_id", "kb").join(targets, ["question_id", "kb"], "left_anti")
    return below.unionByName(free.join(files, "kb").select("question_id", "kb", "path"))


def headlines(questions: DataFrame, docs: DataFrame, lookup: bool) -> DataFrame:
    """question_id, kb, headline, n: the first line of the answer, which the lines of found_files or scoped_files follow, and their number."""
    pairs = ["question_id", "kb"]
    if lookup:
        counts = found_files(questions, docs).groupBy(*pairs).agg(F.count("*").alias("n"))
    else:
        # where no folder is named all files count, which needs one count a tenant and no rows
        targets, files = asked_folders(questions, docs), entries(docs)
        below = files.withColumn("target", F.explode(ancestors(F.col("folder")))).join(targets, ["kb", "target"]).select(*pairs, "path").distinct().groupBy(*pairs).agg(F.count("*").alias("n"))
        free = questions.select(*pairs).join(targets, pairs, "left_anti")
        counts = below.unionByName(free.join(files.groupBy("kb").agg(F.count("*").alias("n")), "kb").select(*pairs, "n"))
    df = questions.select(*pairs).join(counts, pairs, "left").fillna(0, ["n"])
    if lookup:
        head = F.when(F.col("n") > 0, F.format_string(FOUND, "n")).otherwise(NO_FILE)
    else:
        in_order = F.sort_array(F.collect_list(F.struct((-F.length("target")).alias("l"), F.lower("target").alias("o"), F.col("target").alias("t"))))
        named = asked_folders(questions, docs).groupBy("question_id", "kb").agg(F.array_join(F.transform(in_order, lambda x: code_line(x["t"])), "、").alias("scope"))
        df = df.join(named, ["question_id", "kb"], "left")
        head = F.when(F.col("n") > 0, F.format_string(LISTED, F.coalesce("scope", F.lit(EVERYWHERE)), "n")).otherwise(NO_FOLDER)
    ready = entries(docs).select("kb").distinct().withColumn("_ready", F.lit(True))
    return df.join(ready, "kb", "left").select("question_id", "kb", F.when(F.col("_ready"), head).otherwise(EMPTY).alias("headline"), "n")


def code_line(path: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(path, F.lit("`"), F.lit("\\`")), F.lit("`"))


def format_name(name: Column) -> Column:
    """The suffix without its dot, or `unknown`."""
    return F.coalesce(F.nullif(F.substring(extension(name), 2, 100), F.lit("")), F.lit("unknown"))
