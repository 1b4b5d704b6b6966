"""Queries over the driver tables, and the same questions in DuckDB SQL where SQL can ask them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import STOPWORDS, basename, clean, community_colour, parent
from vellum.operators import diffs, graph, index, mentions, pairs, ranks, search, signals
from vellum.sources import notes as vault
from vellum.storage import once, shared_folder
from vellum.streaming import changes, folds, frames, index_log

#: The note, the excluded folder and the searches that the queries ask about.
NOTE, EXCLUDED, EXCLUDED_NOTE = "src3/doc-000003.md", "src0", "src0/doc-000020.md"
QUERY, TITLE_QUERY, SCOPE = "the thing with ontion therat linking", "the", "src1/"
GREP = ["the and", "LA DE"]
#: Notes with many near-duplicates, orphans, unlinked neighbours and near notes of their folder.
DUPLICATED, RESCUER, UNLINKED, NEIGHBOUR = "src1/doc-000001.md", "src14/doc-000174.md", "src17/doc-000677.md", "src8/doc-000008.md"
#: The line that a reader adds to each document under review.
READER = "a reader's own line"


def notes_of(spark: SparkSession, d: str) -> DataFrame:
    return vault.document_notes(spark, d)


def built(spark: SparkSession, d: str) -> index.NoteIndex:
    return index.shared(d, notes_of(spark, d), [EXCLUDED], "en")


def linked(spark: SparkSession, d: str) -> tuple[index.NoteIndex, DataFrame, DataFrame]:
    return built(spark, d), vault.line_links(spark, d), vault.page_dangling(spark, d)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def rounded_ratio(df: DataFrame, col: str) -> DataFrame:
    """rounded() of ratios of counts, for very many rows: no decimal number is made for each. A ratio of numbers below 10^6 is on a half or farther from it than doubles err."""
    return df.withColumn(col, F.floor(F.col(col) * 1e6 + 0.5) / 1e6)


def pairs_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, before, after, doc, kind): each document with the first line of the one before it of its source; doc has a line of the reader's besides.

    Only ids are ordered; the texts meet by doc_id, which names a document.
    """
    read = spark.read.parquet(f"{d}/documents.parquet")
    docs = read.select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    ids = ranks.with_previous(read.select("doc_id", "source"), "prior", "doc_id", ["source"], "doc_id").select("doc_id", "prior")
    earlier = docs.select(F.col("doc_id").alias("prior"), F.col("before").alias("other"))
    rows = docs.join(ids, "doc_id").join(earlier, "prior", "left").withColumn("other", F.coalesce("other", F.lit("")))
    lines = F.split("before", "\n")
    edited = F.concat_ws("\n", F.element_at(F.split("other", "\n"), 1), F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 1), "\n"))
    return rows.select("doc_id", "before", edited.alias("after"), F.concat(edited, F.lit(f"\n{READER}")).alias("doc"), F.lit("modify").alias("kind"))


def writes_of(spark: SparkSession, d: str) -> DataFrame:
    """(session, seq, path, kind, before, after, from): documents as successive writes of one file for each source."""
    docs = pairs_of_texts(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id")
    return docs.select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.concat(F.lit("note-"), (F.col("doc_id") % 40).cast("string"), F.lit(".md")).alias("path"), F.lit("modify").alias("kind"), "before", "after", F.lit(None).cast("string").alias("from"))


def frames_of(spark: SparkSession, d: str) -> DataFrame:
    """(turn, seq, frame): conversations as frames, texts as deltas and a last frame that ends the turn."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    delta = F.to_json(F.struct(F.lit("chat_event").alias("type"), F.struct(F.lit("delta").alias("type"), F.lit("text").alias("kind"), "text").alias("event")))
    ends = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select(F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").alias("seq"), F.lit('{"type":"chat_done","answer":"ok"}').alias("frame"))
    return rows.select(F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").alias("seq"), delta.alias("frame")).unionByName(ends).withColumnRenamed("turn_id", "turn")


def titles_of(spark: SparkSession, d: str) -> DataFrame:
    return mentions.unique_titles(notes_of(spark, d)).filter(F.length("title") >= 2)


def edged(spark: SparkSession, d: str) -> tuple[DataFrame, index.NoteIndex, tuple]:
    """(edges, index, version) of the note graph; edges are found once for an application and a version of notes and links."""
    i, links, _ = linked(spark, d)
    version = (d, *index.version(i.notes, "path", "mtime"), *index.version(links, "src", "dst", "n"))
    return once(spark, ("edges", *version), lambda: graph.kept(graph.graph_edges(i, links), "edges")), i, version


def communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, index.NoteIndex]:
    """(members, edges, index) of the communities of all notes, found once for an application and a version of notes and links."""
    edges, i, version = edged(spark, d)
    return once(spark, ("communities", *version), lambda: graph.kept(graph.louvain(edges, i.notes.select("path")), "communities")), edges, i


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """The layout of the notes with most edges; it does not ask for communities."""
    edges, _, _ = edged(spark, d)
    nodes = graph.kept(graph.graph_nodes(edges), "nodes")
    return graph.layout(graph.truncated(edges, nodes), nodes)


def posted(spark: SparkSession, d: str) -> DataFrame:
    i = built(spark, d)
    p = once(spark, ("postings", d, *index.version(i.notes, "path", "mtime")), lambda: index.postings(i))
    return search.bm25_of_postings(p, [r["stem"] for r in search.terms(i, QUERY).collect()])


def linking_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their links written out at the end of the body, in four forms in turn, and each once more in code."""
    notes, links = notes_of(spark, d), vault.line_links(spark, d)
    turn = F.row_number().over(Window.partitionBy("src").orderBy("dst")) % 4
    name, path = basename(F.col("dst")), F.regexp_replace("dst", r"\.md$", "")
    say = F.when(F.col("turn") == 0, F.concat(F.lit("[["), name, F.lit("]]"))).when(F.col("turn") == 1, F.concat(F.lit("[["), path, F.lit("|see it]]")))
    say = say.when(F.col("turn") == 2, F.concat(F.lit("![["), name, F.lit("#part]]"))).otherwise(F.concat(F.lit("[go]("), path, F.lit(".md#part)")))
    line = F.concat(F.lit("see "), say, F.lit(" not `[["), name, F.lit("]]`"))
    lines = links.withColumn("turn", turn).select("src", F.struct("dst", line.alias("line")).alias("s")).groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.concat_ws("\n", "content", F.array_join(F.col("s.line"), "\n"))
    return notes.join(lines, "path", "left").withColumn("content", F.when(F.col("s").isNull(), F.col("content")).otherwise(body)).drop("s")


def moves_of(notes: DataFrame) -> DataFrame:
    to = F.concat(F.lit("moved/"), F.regexp_replace("path", "/doc-", "/new-"))
    return notes.filter("mtime % 10 = 4").select("path", to.alias("to"))


def with_front_matter(notes: DataFrame) -> DataFrame:
    """Notes that start with front matter: a text, a number, a truth value and a list."""
    top = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nnumber: "), F.col("mtime").cast("string"), F.lit("\ndraft: true\ntags:\n  - note\n  - "), parent(F.col("path")), F.lit("\n---\n"), "content")
    return notes.withColumn("content", top)


def maintained(spark: SparkSession, d: str) -> DataFrame:
    """The stems of an index that got all notes, then emptied, deleted and moved ones, then a base."""
    notes = notes_of(spark, d)
    folder = f"{shared_folder(spark)}/tables/index-{uuid.uuid4().hex}"
    index_log.add_batch(notes, folder, 0)
    later = (F.col("mtime") + 1_000_000).alias("mtime")
    gone = notes.filter("mtime % 17 = 0 or mtime % 19 = 1").select("path", later, F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone"))
    emptied = notes.filter("mtime % 13 = 5 and mtime % 17 <> 0 and mtime % 19 <> 1").select("path", later, F.lit("").alias("content"), F.lit(False).alias("gone"))
    came = notes.filter("mtime % 19 = 1").select(F.concat(F.lit("moved/"), "path").alias("path"), later, "content", F.lit(False).alias("gone"))
    index_log.add_batch(gone.unionByName(emptied).unionByName(came), folder, 1)
    index_log.compact(spark, folder)
    index_log.add_batch(notes.filter("mtime % 17 = 0").select("path", "mtime", "content"), folder, 2)  # older than the deletion
    return index_log.current_counts(spark, folder)


def connections_of(spark: SparkSession, d: str) -> DataFrame:
    """(connection, seq, frame): conversations as connections; some are refused, and some say something before they are let in."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "rpc").when(F.col("turn") % 3 == 1, "chat_event").otherwise("ping").alias("type"), F.col("text").alias("text")))
    hello = F.when(F.col("conv_id") % 5 == 0, '{"type":"bye"}').otherwise('{"type":"welcome"}')
    first = rows.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("connection"), F.when(F.col("conv_id") % 3 == 0, 15).otherwise(-5).cast("long").alias("seq"), hello.alias("frame"))
    return first.unionByName(rows.select(F.col("conv_id").cast("string").alias("connection"), (10 * F.col("turn")).cast("long").alias("seq"), text.alias("frame")))


def reviewed(spark: SparkSession, d: str, action: str) -> DataFrame:
    rows = pairs_of_texts(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.lit(action).alias("action"), "before", "after", "doc", F.lit(None).cast("string").alias("hunk"))
    return diffs.review(rows).select("path", F.md5("before").alias("baseline"), F.md5("after").alias("written"), F.md5("doc").alias("document"), "open")


def edits_of(notes: DataFrame) -> DataFrame:
    return notes.filter("mtime % 10 = 3").select("path", F.lit("edited\n").alias("content"))


def old_state(notes: DataFrame) -> DataFrame:
    """An earlier version of the notes: every seventh had another time and text, every eleventh was not there."""
    changed = F.col("mtime") % 7 == 0
    return notes.filter("mtime % 11 <> 0").withColumns({"content": F.when(changed, F.lit("older words")).otherwise(F.col("content")), "mtime": F.when(changed, F.col("mtime") - 1).otherwise(F.col("mtime"))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    # text and index
    q["clean_body"] = lambda s, d: notes_of(s, d).select("path", clean(F.col("content")).alias("body"))
    q["token_counts"] = lambda s, d: index.token_counts(notes_of(s, d))
    q["stem_counts"] = lambda s, d: index.stem_counts(notes_of(s, d))
    q["note_lengths"] = lambda s, d: index.lengths(notes_of(s, d), index.stem_counts(notes_of(s, d)))
    q["doc_frequency"] = lambda s, d: index.document_frequency(index.stem_counts(notes_of(s, d)))
    q["detect_language"] = lambda s, d: index.detect_language(index.marked(notes_of(s, d), [EXCLUDED]))
    q["excluded_notes"] = lambda s, d: index.marked(notes_of(s, d), [EXCLUDED]).filter("excluded").select("path")
    q["topk_stems"] = lambda s, d: built(s, d).top.select("path", "stem", "n", "rn")
    q["discriminating_stems"] = lambda s, d: built(s, d).disc
    q["incremental_refresh"] = lambda s, d: index.refresh(old_state(notes_of(s, d)), index.stem_counts(old_state(notes_of(s, d))), notes_of(s, d))
    # pairs
    q["candidate_pairs"] = lambda s, d: pairs.candidates(built(s, d))
    q["related_notes"] = lambda s, d: rounded(pairs.related(built(s, d), NOTE), "score")
    q["related_excluded_source"] = lambda s, d: rounded(pairs.related(built(s, d), EXCLUDED_NOTE), "score")
    q["scored_pairs"] = lambda s, d: rounded_ratio(pairs.scored_pairs(built(s, d)), "score")
    q["all_edges"] = lambda s, d: rounded_ratio(pairs.edges(built(s, d)), "score")
    # search
    q["bm25_search"] = lambda s, d: rounded(search.bm25(built(s, d), QUERY), "score")
    q["bm25_postings"] = lambda s, d: rounded(posted(s, d), "score")
    q["title_search"] = lambda s, d: rounded(search.title_hits(notes_of(s, d), TITLE_QUERY), "score")
    q["fused_search"] = lambda s, d: rounded(search.search(built(s, d), TITLE_QUERY + " " + QUERY), "score")
    q["scoped_search"] = lambda s, d: rounded(search.search(built(s, d), "ontion thing", 20, SCOPE), "score")
    q["split_scope"] = lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", search.split_scope(F.concat(F.lit("Path:/A "), F.coalesce("text", F.lit("")), F.lit("  path:Src1/"))).alias("p")).select("item_id", "p.query", "p.scope")
    q["snippet_window"] = lambda s, d: notes_of(s, d).select("path", search.snippet_window(F.col("content"), "ontion thing").alias("snippet"))
    q["snippet_pieces"] = lambda s, d: search.snippets(search.bm25(built(s, d), QUERY, 20), notes_of(s, d), QUERY)
    # signals
    q["in_degree"] = lambda s, d: signals.in_degree(vault.line_links(s, d))
    q["near_duplicates"] = lambda s, d: rounded(signals.near_duplicates(built(s, d), DUPLICATED), "score")
    q["adoptable_orphans"] = lambda s, d: rounded(signals.adoptable_orphans(*linked(s, d)[:2], RESCUER), "score")
    q["unlinked_neighbours"] = lambda s, d: rounded(signals.unlinked_neighbours(*linked(s, d)[:2], UNLINKED), "score")
    q["stale_links"] = lambda s, d: rounded(signals.stale_links(*linked(s, d)[:2]), "score")
    q["dangling_links"] = lambda s, d: vault.page_dangling(s, d)
    q["attention_queue"] = lambda s, d: rounded(signals.attention_queue(*linked(s, d)), "score")
    q["note_panel"] = lambda s, d: rounded(signals.panel(*linked(s, d), NOTE), "score")
    q["panel_rows"] = lambda s, d: signals.presented(signals.panel(*linked(s, d), NOTE), notes_of(s, d), NOTE)
    q["panel_same_folder"] = lambda s, d: signals.presented(signals.panel(*linked(s, d), NEIGHBOUR), notes_of(s, d), NEIGHBOUR, True)
    q["stale_of_note"] = lambda s, d: rounded(signals.stale_order(signals.stale_links(*linked(s, d)[:2]), DUPLICATED), "score")
    q["queue_next"] = lambda s, d: rounded(signals.next_row(signals.attention_queue(*linked(s, d)), 3, NOTE), "score")
    q["top_set"] = lambda s, d: index.top_set(built(s, d), NOTE)
    # vault
    q["list_files"] = lambda s, d: vault.request(notes_of(s, d), "list_files", folder="src1")
    q["read_note"] = lambda s, d: vault.request(notes_of(s, d), "read", path="/" + NOTE)
    q["outline"] = lambda s, d: vault.outline(notes_of(s, d).withColumn("content", F.regexp_replace("content", r"(?m)^([A-Z]\S+ )", "## $1"))).select("path", "line", "level", "heading")
    q["text_links"] = lambda s, d: vault.request(linking_notes(s, d), "resolved_links")
    q["vault_move_texts"] = lambda s, d: vault.request(linking_notes(s, d), "move", moves=moves_of(notes_of(s, d))).select("path", F.md5("content").alias("digest"))
    q["note_properties"] = lambda s, d: vault.properties(with_front_matter(notes_of(s, d))).select("path", F.to_json("frontmatter").alias("json"))
    q["vault_set_property"] = lambda s, d: vault.set_property(with_front_matter(notes_of(s, d)), notes_of(s, d).filter("mtime % 3 = 0").select("path", F.lit("number").alias("name"), F.to_json(F.array(F.col("mtime"), F.col("mtime") + 1)).alias("value"))).select("path", F.md5("content").alias("digest"))
    q["grep_lines"] = lambda s, d: mentions.grep(notes_of(s, d), GREP[:1])
    q["grep_batch"] = lambda s, d: mentions.grep(notes_of(s, d), GREP)
    q["unique_titles"] = lambda s, d: mentions.unique_titles(notes_of(s, d))
    q["mention_index"] = lambda s, d: mentions.mentions(notes_of(s, d), titles_of(s, d))
    q["autolink"] = lambda s, d: mentions.autolink(notes_of(s, d)).select("path", "added", F.md5("content").alias("digest"))
    q["vault_create"] = lambda s, d: vault.create(notes_of(s, d), notes_of(s, d).filter("mtime % 10 = 3").select(F.concat(F.lit("new//"), "path").alias("path"), "content")).select("path", "basename", F.md5("content").alias("digest"))
    q["vault_overwrite"] = lambda s, d: vault.overwrite(notes_of(s, d), edits_of(notes_of(s, d))).select("path", F.md5("content").alias("digest"))
    q["vault_append"] = lambda s, d: vault.append(notes_of(s, d), edits_of(notes_of(s, d))).select("path", F.md5("content").alias("digest"))
    q["vault_move"] = lambda s, d: vault.move(notes_of(s, d), vault.line_links(s, d), notes_of(s, d).filter("mtime % 10 = 3").select("path", F.concat(F.lit("moved/"), "path").alias("to")))[1]
    q["vault_delete"] = lambda s, d: vault.delete(notes_of(s, d), notes_of(s, d).filter("mtime % 10 = 3").select("path"))[0].select("path")
    # diffs
    q["diff_lines"] = lambda s, d: diffs.diff_lines(pairs_of_texts(s, d)).select("doc_id", diffs.tally(F.col("lines")).alias("t")).select("doc_id", "t.added", "t.removed")
    q["hunk_ranges"] = lambda s, d: diffs.hunk_ranges(pairs_of_texts(s, d)).select("doc_id", F.explode("hunks").alias("h")).select("doc_id", "h.before_start", "h.before_end", "h.after_start", "h.after_end")
    q["grouped_hunks"] = lambda s, d: diffs.grouped_hunks(diffs.diff_lines(pairs_of_texts(s, d)), "doc_id")
    q["revert_hunks"] = lambda s, d: diffs.revert_pending(pairs_of_texts(s, d)).select("doc_id", F.md5("text").alias("digest"))
    q["change_fold"] = lambda s, d: changes.change_fold(writes_of(s, d)).select("session", "position", "path", "kind", F.md5("before").alias("before"), F.md5("after").alias("after"))
    q["changes_panel"] = lambda s, d: diffs.changes_panel(diffs.diff_lines(pairs_of_texts(s, d)), "doc_id").select("doc_id", "letter", "added", "removed", "total", F.size("shown").alias("shown"))
    q["review_accept"] = lambda s, d: reviewed(s, d, "accept")
    q["review_reject"] = lambda s, d: reviewed(s, d, "reject")
    q["hunk_decorations"] = lambda s, d: diffs.decorations(diffs.hunk_ranges(pairs_of_texts(s, d)), "doc_id", "after")
    # graph
    q["graph_edges"] = lambda s, d: rounded_ratio(graph.graph_edges(*linked(s, d)[:2]), "w")
    q["graph_nodes"] = lambda s, d: graph.graph_nodes(graph.graph_edges(*linked(s, d)[:2]), 200)
    q["louvain"] = lambda s, d: communities(s, d)[0]
    q["community_sizes"] = lambda s, d: graph.community_sizes(communities(s, d)[0])
    q["community_labels"] = lambda s, d: (lambda c: graph.community_labels(c[0], c[2]))(communities(s, d))
    q["community_legend"] = lambda s, d: (lambda c: graph.legend(c[0], graph.community_labels(c[0], c[2])))(communities(s, d))
    q["graph_layout"] = drawn
    q["community_color"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("community"), community_colour(F.col("doc_id")).alias("dark"), community_colour(F.col("doc_id"), True).alias("paper"))
    # folds
    q["conversation_texts"] = lambda s, d: folds.conversation_texts(s.read.parquet(f"{d}/conversations.parquet"))
    q["maintained_index"] = maintained
    q["routed_frames"] = lambda s, d: frames.routed(connections_of(s, d)).select("connection", "seq", "route")
    q["chat_turns"] = lambda s, d: folds.chat_turns(frames_of(s, d)).select("turn", F.md5("text").alias("digest"), "answer", "done")
    q["debounce_events"] = lambda s, d: folds.debounced(s.read.parquet(f"{d}/events.parquet"), "10 minutes")
    return q


def sql_list(lang: str) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS[lang])))


#: Notes, tokens, stems, top stems and telling stems; every oracle starts from these.
BASE = f"""
with notes as (
  select concat(source, '/doc-', lpad(cast(doc_id as varchar), 6, '0'), '.md') as path, concat('doc-', lpad(cast(doc_id as varchar), 6, '0')) as basename,
    doc_id as mtime, coalesce(text, '') as content, array_to_string(list_slice(regexp_extract_all(lower(text), '\\p{{L}}+'), 1, 2), ' ') as title, source = '{EXCLUDED}' as excluded
  from documents
), cleaned as (
  select path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    content,
    '\\A---\\r?\\n[\\s\\S]*?\\r?\\n---[ \\t]*\\r?\\n?', ' ', 'g'),
    '(?m)^```[^\\n]*\\n[\\s\\S]*?^```[ \\t]*$|^~~~[^\\n]*\\n[\\s\\S]*?^~~~[ \\t]*$', ' ', 'g'),
    '(?m)^(?:```|~~~)[\\s\\S]*', ' ', 'g'),
    '`[^`\\n]+`', ' ', 'g'),
    '\\$\\$[\\s\\S]*?\\$\\$', ' ', 'g'),
    '\\$[^$\\n]+\\$', ' ', 'g'),
    '!\\[\\[[^\\]]*\\]\\]', ' ', 'g'),
    'https?://\\S+|www\\.\\S+', ' ', 'g'),
    '\\[\\[([^\\]]+)\\]\\]', ' \\1 ', 'g'),
    '[|#^]', ' ', 'g') as body from notes
), words as (
  select path, unnest(regexp_extract_all(lower(body), '\\p{{L}}[\\p{{L}}\\p{{M}}''’-]*')) as token from cleaned
), singular as (
  select path, token, case
    when length(token) <= 3 then token
    when token like '%ies' then case when token like '%eies' or token like '%aies' then token else concat(left(token, length(token) - 3), 'y') end
    when token like '%es' then case when token like '%aes' or token like '%ees' or token like '%oes' then token else left(token, length(token) - 1) end
    when token like '%s' then case when token like '%us' or token like '%ss' then token else left(token, length(token) - 1) end
    else token end as w
  from words where length(token) >= 3 and token not in ({sql_list("en")})
), stems as (
  select path, case
    when length(token) <= 3 then token
    when w like '%ingly' and length(w) >= 8 then left(w, length(w) - 5)
    when w like '%edly' and length(w) >= 7 then left(w, length(w) - 4)
    when w like '%ing' and length(w) >= 6 then left(w, length(w) - 3)
    when w like '%ed' and length(w) >= 6 then left(w, length(w) - 2)
    when w like '%ly' and length(w) >= 6 then left(w, length(w) - 2)
    else w end as stem
  from singular
), counts as (
  select path, stem, count(*) as n from stems group by all
), dfs as (
  select stem, count(*) as df from counts group by stem
), top as (
  select c.path, c.stem, c.n, x.excluded, row_number() over (partition by c.path order by c.n desc, c.stem) as rn
  from counts c join notes x using (path) qualify rn <= 30
), disc as (
  select path, stem from counts where stem not in (select stem from dfs, (select count(*) as k from notes) where k >= 20 and df >= 3 and df / k > 0.25)
), sizes as (
  select path, count(*) as k from top group by path
), dsizes as (
  select path, count(*) as k from disc group by path
), links as (
  select a.path as src, b.path as dst, count(*) as n
  from (select s, (2 * case when s % 10 = 0 then l_partkey else 7 * s + l_partkey % 3 end) % k as d from (select l_orderkey % k as s, l_partkey, k from lineitem, (select count(*) as k from documents))) l
  join notes a on a.mtime = l.s join notes b on b.mtime = l.d group by all
), dangling as (
  select x.path as src, p.target, count(*) as n
  from (select page_id % k as s, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages, (select count(*) as k from documents)) p
  join notes x on x.mtime = p.s group by all
)"""

#: All pairs of notes from 0.08 on, with both overlaps; written pairs; notes that something points at.
PAIRS = """, met as (
  select a.path as a, b.path as b, count(*) as shared from top a join top b on a.stem = b.stem and a.path < b.path where not a.excluded and not b.excluded group by all
), scored as (
  select m.a, m.b, shared / (x.k + y.k - shared) as score from met m join sizes x on x.path = m.a join sizes y on y.path = m.b where shared / (x.k + y.k - shared) >= 0.08
), dmet as (
  select s.a, s.b, count(*) as shared from scored s join disc p on p.path = s.a join disc q on q.path = s.b and q.stem = p.stem group by all
), gated as (
  select s.a, s.b, s.score, coalesce(d.shared / (x.k + y.k - d.shared), 0) as overlap
  from scored s left join dmet d using (a, b) left join dsizes x on x.path = s.a left join dsizes y on y.path = s.b
), written as (
  select distinct least(src, dst) as a, greatest(src, dst) as b from links
), pointed as (select distinct dst as path from links)"""


def near_sql(path: str) -> str:
    return f""", mine as (select stem from top where path = '{path}'), own as (select stem from disc where path = '{path}'),
m as (select path, count(*) as shared from top where stem in (select stem from mine) and path <> '{path}' and not excluded group by path),
d as (select path, count(*) as shared from disc where stem in (select stem from own) group by path),
near as (
  select m.path, m.shared / (s.k + (select count(*) from mine) - m.shared) as score, coalesce(d.shared / (t.k + (select count(*) from own) - d.shared), 0) as overlap
  from m join sizes s using (path) left join d using (path) left join dsizes t using (path)
)"""


def bm25_sql(query: str, limit: int, scope: str = "", name: str = "bm") -> str:
    stems = f"""(select distinct case when w like '%ing' and length(w) >= 6 then left(w, length(w) - 3) when w like '%ed' and length(w) >= 6 then left(w, length(w) - 2) when w like '%ly' and length(w) >= 6 then left(w, length(w) - 2) else w end as stem
    from (select case when length(t) > 3 and t like '%es' then left(t, length(t) - 1) when length(t) > 3 and t like '%s' and t not like '%ss' and t not like '%us' then left(t, length(t) - 1) else t end as w
    from (select unnest(string_split('{query}', ' ')) as t) where length(t) >= 3 and t not in ({sql_list("en")})))"""
    return f""", {name} as (
  select c.path, sum(ln(1 + (k - df + 0.5) / (df + 0.5)) * c.n * 2.5 / (c.n + 1.5 * (1 - 0.75 + 0.75 * len / mean))) as score
  from counts c join {stems} using (stem) join dfs using (stem) join (select path, sum(n) as len from counts group by path) using (path),
    (select count(*) as k, sum(coalesce(len, 0)) / count(*) as mean from notes left join (select path, sum(n) as len from counts group by path) using (path))
  where starts_with(c.path, '{scope}') group by c.path order by score desc, c.path limit {limit}
)"""


def title_sql(query: str, limit: int, scope: str = "", name: str = "ti") -> str:
    return f""", {name} as (
  select path, {len(query)} / length(title) as score from notes where contains(title, '{query}') and starts_with(path, '{scope}') order by score desc, path limit {limit}
)"""


FUSED = """, fused as (
  select path, sum(1.0 / (60 + rn)) as score from (
    select path, row_number() over (order by score desc, path) as rn from bm union all select path, row_number() over (order by score desc, path) as rn from ti) group by path
) select path, title, round(score, 6) as score from notes join fused using (path)"""

QUEUE = """, told as (
  select a as path, 'duplicates' as kind, overlap as score from gated where overlap >= 0.5 union all select b, 'duplicates', overlap from gated where overlap >= 0.5
), offered as (
  select * from gated g where overlap < 0.5 and overlap >= 0.08 and not exists (select 1 from written w where w.a = g.a and w.b = g.b)
), said as (
  select * from told
  union all select a, 'missing', score from offered where score >= 0.25 union all select b, 'missing', score from offered where score >= 0.25
  union all select a, 'orphans', score from offered where b not in (select path from pointed) union all select b, 'orphans', score from offered where a not in (select path from pointed)
), signals as (
  select path, kind, count(*) as n, max(score) as score from said group by all
  union all select src, 'dangling', count(distinct target), count(distinct target) from dangling join notes on path = src where not excluded group by src
), placed as (
  select *, row_number() over (partition by kind order by score desc, path) as rn from signals
), summed as (
  select path, sum(1.0 / (60 + rn)) as score, sum(case when kind = 'duplicates' then n else 0 end) as du, sum(case when kind = 'orphans' then n else 0 end) as orp,
    sum(case when kind = 'missing' then n else 0 end) as mi, sum(case when kind = 'dangling' then n else 0 end) as da from placed group by path
)
select path, round(score, 6) as score, concat_ws(', ',
  case when du > 0 then concat(cast(du as bigint), case when du = 1 then ' near-duplicate' else ' near-duplicates' end) end,
  case when orp > 0 then concat(cast(orp as bigint), case when orp = 1 then ' orphan to adopt' else ' orphans to adopt' end) end,
  case when mi > 0 then concat(cast(mi as bigint), case when mi = 1 then ' unlinked neighbour' else ' unlinked neighbours' end) end,
  case when da > 0 then concat(cast(da as bigint), case when da = 1 then ' broken link' else ' broken links' end) end) as reason
from summed order by summed.score desc, path limit 100"""

_FLAT = "trim(regexp_replace(regexp_replace(content, '\\A---\\r?\\n[\\s\\S]*?\\r?\\n---[ \\t]*\\r?\\n?', ''), '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["clean_body"] = BASE + " select path, body from cleaned"
    o["token_counts"] = BASE + " select path, token, count(*) as n from words group by all"
    o["stem_counts"] = BASE + " select path, stem, n from counts"
    o["note_lengths"] = BASE + " select path, cast(coalesce(sum(n), 0) as bigint) as len from notes left join counts using (path) group by path"
    o["doc_frequency"] = BASE + " select stem, df from dfs"
    o["excluded_notes"] = BASE + " select path from notes where excluded"
    o["detect_language"] = BASE + f""", first as (select content from notes order by excluded, path limit 8), t as (select unnest(regexp_extract_all(lower(content), '\\p{{L}}[\\p{{L}}\\p{{M}}''’-]*')) as token from first)
      select case when count(*) filter (token in ({sql_list("it")})) > count(*) filter (token in ({sql_list("en")})) then 'it' else 'en' end as lang from t"""
    o["topk_stems"] = BASE + " select path, stem, n, cast(rn as integer) as rn from top"
    o["discriminating_stems"] = BASE + " select path, stem from disc"
    o["incremental_refresh"] = BASE + " select path, stem, n from counts"
    o["candidate_pairs"] = BASE + " select a.path as a, b.path as b, count(*) as shared from top a join top b on a.stem = b.stem and a.path < b.path where not a.excluded and not b.excluded group by all"
    for name, path in (("related_notes", NOTE), ("related_excluded_source", EXCLUDED_NOTE)):
        o[name] = BASE + near_sql(path) + " select path, round(score, 6) as score from near where score >= 0.12 and overlap >= 0.02 order by near.score desc, path limit 20"
    o["scored_pairs"] = BASE + PAIRS + " select a, b, round(score, 6) as score from scored"
    o["all_edges"] = BASE + PAIRS + " select a, b, round(score, 6) as score from gated where score >= 0.25 and overlap >= 0.02"
    o["bm25_search"] = BASE + bm25_sql(QUERY, 50) + " select path, round(score, 6) as score from bm"
    o["bm25_postings"] = o["bm25_search"]
    o["title_search"] = BASE + title_sql(TITLE_QUERY, 50) + " select path, round(score, 6) as score from ti"
    both = TITLE_QUERY + " " + QUERY
    o["fused_search"] = BASE + bm25_sql(both, 100) + title_sql(both, 100) + FUSED + " order by fused.score desc, path limit 50"
    o["scoped_search"] = BASE + bm25_sql("ontion thing", 40, SCOPE) + title_sql("ontion thing", 40, SCOPE) + FUSED + " order by fused.score desc, path limit 20"
    o["split_scope"] = "select item_id, trim(regexp_replace(concat(' ', coalesce(text, ''), ' '), '\\s+', ' ', 'g')) as query, 'src1/' as scope from benchmark"
    o["snippet_window"] = BASE + f""", f as (select path, {_FLAT} as text from notes), g as (select path, text, strpos(lower(text), 'ontion') as p, strpos(lower(text), 'thing') as q from f)
      select path, substr(text, cast(greatest(coalesce(least(nullif(p, 0), nullif(q, 0)) - 1, 0) - 50, 0) as bigint) + 1, 170) as snippet from g"""
    o["in_degree"] = BASE + " select dst as path, cast(sum(n) as bigint) as deg from links group by dst"
    o["near_duplicates"] = BASE + near_sql(DUPLICATED) + " select path, round(overlap, 6) as score from near where score >= 0.08 and overlap >= 0.5 order by near.overlap desc, path limit 10"
    o["adoptable_orphans"] = BASE + near_sql(RESCUER) + " select path, round(score, 6) as score from near where score >= 0.08 and overlap >= 0.08 and path not in (select dst from links) order by near.score desc, path limit 10"
    unlinked = lambda note: f"path not in (select dst from links where src = '{note}' union all select src from links where dst = '{note}')"
    o["unlinked_neighbours"] = BASE + near_sql(UNLINKED) + f" select path, round(score, 6) as score from near where score >= 0.25 and overlap >= 0.08 and {unlinked(UNLINKED)} order by near.score desc, path limit 10"
    stale = """, few as (select src from links group by src having count(*) <= 12), k as (
      select l.src, l.dst, count(q.stem) as shared from links l join few using (src) join notes n on n.path = l.src and not n.excluded join disc p on p.path = l.src left join disc q on q.path = l.dst and q.stem = p.stem group by all
    ), thin as (select k.src, k.dst, shared / (x.k + y.k - shared) as score from k join dsizes x on x.path = k.src join dsizes y on y.path = k.dst where shared / (x.k + y.k - shared) < 0.02)"""
    o["stale_links"] = BASE + stale + " select src, dst, round(score, 6) as score from thin"
    o["dangling_links"] = BASE + " select src, target, n from dangling"
    o["attention_queue"] = BASE + PAIRS + QUEUE
    def panel(note: str) -> str:
        return BASE + near_sql(note) + stale + f""", listed as (
      select * from (select 'duplicates' as kind, 1 as turn, path, overlap as score from near where score >= 0.08 and overlap >= 0.5 order by near.overlap desc, path limit 10)
      union all select * from (select 'orphans', 2, path, score from near where score >= 0.08 and overlap >= 0.08 and path not in (select dst from links) order by near.score desc, path limit 10)
      union all select * from (select 'related', 3, path, score from near where score >= 0.12 and overlap >= 0.02 order by near.score desc, path limit 20)
    ), once as (select *, row_number() over (partition by path order by turn) as c from listed), p as (
      select kind, o.path as other, o.score, kind = 'related' and n.score >= 0.25 and n.overlap >= 0.08 and o.{unlinked(note)} as unlinked from once o join near n on n.path = o.path where c = 1
      union all select 'stale', dst, score, false from thin where src = '{note}'
      union all select distinct 'dangling', target, 0.0, false from dangling where src = '{note}')"""

    shown = """ select kind, other, coalesce(n.basename, other) as title, coalesce(t.same > 1, false) as ambiguous,
      cast(round(100 * score / case when max(score) over (partition by kind) > 0 then max(score) over (partition by kind) else 1 end) as integer) as percent, printf('%.2f', score) as shown, unlinked
      from p left join notes n on n.path = other left join (select basename, count(*) as same from notes group by basename) t using (basename)"""
    o["note_panel"] = panel(NOTE) + " select kind, other, round(score, 6) as score, unlinked from p"
    o["panel_rows"] = panel(NOTE) + shown
    o["panel_same_folder"] = panel(NEIGHBOUR) + shown + f" where kind = 'dangling' or starts_with(other, '{NEIGHBOUR.split('/')[0]}/')"
    o["stale_of_note"] = BASE + stale + f" select src, dst, round(score, 6) as score from thin where src = '{DUPLICATED}'"
    o["queue_next"] = "select path, score, reason from (" + o["attention_queue"] + f") where path <> '{NOTE}' order by score desc, path limit 1 offset 3"
    o["top_set"] = BASE + f" select stem from top where path = '{NOTE}'"
    before = ", pr as (select doc_id, coalesce(text, '') as before, coalesce(lag(coalesce(text, '')) over (partition by source order by doc_id), '') as other from documents), ed as (select doc_id, before, concat(string_split(other, chr(10))[1], chr(10), array_to_string(list_slice(string_split(before, chr(10)), 2, len(string_split(before, chr(10)))), chr(10))) as after from pr)"
    # a changed first line and the reader's line at the end are hunks apart, unless there is but one line, or the new
    # first line is the second one too
    uncut = before + f""", sp as (select *, string_split(before, chr(10)) as b, string_split(after, chr(10)) as a, concat(after, chr(10), '{READER.replace("'", "''")}') as doc from ed
    ), pe as (select *, len(b) as n, b[1] <> a[1] and len(b) >= 2 and a[1] <> b[2] as pend, b[1] <> a[1] as other_first from sp)"""
    before = uncut.replace(" as pend", f" and len(b) * (len(b) + 1) <= {diffs.MAX_CELLS} as pend")  # the fixed number of cells, which accepting does not have
    o["review_accept"] = BASE + uncut + " select cast(doc_id as varchar) as path, md5(case when pend then after else before end) as baseline, md5(after) as written, md5(doc) as document, not pend and before <> after as open from pe"
    undone = f"case when pend then concat(before, chr(10), '{READER.replace(chr(39), chr(39) * 2)}') else doc end"
    o["review_reject"] = BASE + before + f" select cast(doc_id as varchar) as path, md5(before) as baseline, md5(case when pend then before else after end) as written, md5({undone}) as document, not pend and before <> after as open from pe"
    o["revert_hunks"] = BASE + before + f" select doc_id, md5({undone}) as digest from pe"
    # what the change of the first line looks like: an empty text gets two lines, a single line an empty one behind it
    case = lambda empty, single, single_other, other, none: f"case when before = '' then {empty} when n = 1 and not other_first then {single} when n = 1 then {single_other} when other_first then {other} else {none} end"
    added, removed, total = case(2, 1, 2, 1, 0), case(0, 0, 1, 1, 0), case(2, 2, 3, "n + 1", "n")
    o["diff_lines"] = BASE + before + f" select doc_id, cast({added} as integer) as added, cast({removed} as integer) as removed from pe"
    o["changes_panel"] = BASE + before + f" select doc_id, 'M' as letter, cast({added} as integer) as added, cast({removed} as integer) as removed, cast({total} as integer) as total, cast(least({total}, 400) as integer) as shown from pe"
    there = " from pe where before = '' or n = 1 or other_first"
    o["hunk_decorations"] = BASE + before + f""", de as (select doc_id, cast({case(0, 1, 0, 0, 0)} as integer) as line, cast({case(2, 2, 2, 1, 0)} as integer) as past, a from pe where before = '' or n = 1 or other_first)
      select doc_id, 'block' as kind, line, false as at_end from de union all
      select doc_id, 'line', cast(unnest(range(line, past)) as integer), false from de where not regexp_matches(a[line + 1], '^\\s*(?:>|\\|)')"""
    o["hunk_ranges"] = BASE + before + f" select doc_id, cast({case(0, 1, 0, 0, 0)} as integer) as before_start, cast({case(0, 1, 1, 1, 0)} as integer) as before_end, cast({case(0, 1, 0, 0, 0)} as integer) as after_start, cast({case(2, 2, 2, 1, 0)} as integer) as after_end" + there
    o["grouped_hunks"] = BASE + before + f" select doc_id, cast(1 as bigint) as span, 0 as lo, cast({case(2, 2, 3, 'least(4, n + 1)', 0)} as integer) as hi" + there
    o["list_files"] = BASE + " select basename as name, path from notes where starts_with(path, 'src1/')"
    o["read_note"] = BASE + f" select path, content, length(content) as size from notes where path = '{NOTE}'"
    lines = ", l as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from notes)"
    o["outline"] = BASE + ", l as (select path, unnest(string_split(c, chr(10))) as text, generate_subscripts(string_split(c, chr(10)), 1) as line from (select path, regexp_replace(content, '(?m)^([A-Z]\\S+ )', '## \\1', 'g') as c from notes)) select path, cast(line as integer) as line, 2 as level, trim(substr(text, 4)) as heading from l where starts_with(text, '## ') and length(trim(substr(text, 4))) > 0"
    one = f"select '{GREP[0]}' as query, path, cast(line as integer) as line, trim(text) as content from l where contains(lower(text), '{GREP[0].lower()}')"
    o["grep_lines"] = BASE + lines + " " + one
    o["grep_batch"] = BASE + lines + " " + one + f" union all select '{GREP[1]}', path, cast(line as integer), trim(text) from l where contains(lower(text), '{GREP[1].lower()}')"
    o["unique_titles"] = BASE + " select title from notes group by title having count(*) = 1"
    o["mention_index"] = BASE + ", u as (select title from notes group by title having count(*) = 1 and length(title) >= 2) select u.title, path from u, notes where contains(lower(content), u.title) and regexp_matches(u.title, '^[a-z0-9]') and regexp_matches(lower(content), concat('(^|[^a-z0-9])', u.title))"
    o["vault_create"] = BASE + " select path, basename, md5(content) as digest from notes union all select concat('new/', path), basename, md5(content) from notes where mtime % 10 = 3"
    o["vault_overwrite"] = BASE + " select path, md5(case when mtime % 10 = 3 then concat('edited', chr(10)) else content end) as digest from notes"
    o["vault_append"] = BASE + " select path, md5(case when mtime % 10 = 3 then concat(content, 'edited', chr(10)) else content end) as digest from notes"
    o["vault_move"] = BASE + " select case when a.mtime % 10 = 3 then concat('moved/', src) else src end as src, case when b.mtime % 10 = 3 then concat('moved/', dst) else dst end as dst, n from links join notes a on a.path = src join notes b on b.path = dst"
    name = lambda c: f"regexp_replace(regexp_replace({c}, '^.*/', ''), '\\.md$', '')"
    bare = lambda c: f"regexp_replace({c}, '\\.md$', '')"
    written = f"""concat('see ', case turn when 0 then concat('[[', {name("d")}, ']]') when 1 then concat('[[', {bare("d")}, '|see it]]')
      when 2 then concat('![[', {name("d")}, '#part]]') else concat('[go](', {bare("d")}, '.md#part)') end, ' not `[[', {name("dst")}, ']]`')"""
    moved = "case when mtime % 10 = 4 then concat('moved/', replace(path, '/doc-', '/new-')) else path end"
    o["vault_move_texts"] = BASE + f""", t as (select src, dst, row_number() over (partition by src order by dst) % 4 as turn from links), to_ as (select path as dst, {moved} as d from notes),
      w as (select src, string_agg({written}, chr(10) order by dst) as lines from t join to_ using (dst) group by src)
      select {moved} as path, md5(case when lines is null then content else concat(content, chr(10), lines) end) as digest from notes left join w on src = path"""
    o["text_links"] = BASE + " select src, dst as target, cast(1 as bigint) as n, true as found from links"
    o["note_properties"] = BASE + " select path, concat('{\"draft\":true,\"number\":', mtime, ',\"tags\":[\"note\",\"', regexp_replace(path, '/[^/]*$', ''), '\"],\"title\":', case when title = '' then 'null' else concat('\"', title, '\"') end, '}') as json from notes"
    top = "concat('---', chr(10), 'title: ', title, chr(10), case when mtime % 3 = 0 then concat('number:', chr(10), '  - ', mtime, chr(10), '  - ', mtime + 1) else concat('number: ', mtime) end, chr(10), 'draft: true', chr(10), 'tags:', chr(10), '  - note', chr(10), '  - ', regexp_replace(path, '/[^/]*$', ''), chr(10), '---', chr(10), content)"
    o["vault_set_property"] = BASE + f" select path, md5({top}) as digest from notes"
    o["vault_delete"] = BASE + " select path from notes where mtime % 10 <> 3"
    edges = ", e as (select a, b, 1.0 as w, false as inferred from written where a <> b union all select a, b, score, true from gated g where score >= 0.25 and overlap >= 0.02 and not exists (select 1 from written w where w.a = g.a and w.b = g.b))"
    o["graph_edges"] = BASE + PAIRS + edges + " select a, b, round(cast(w as double), 6) as w, inferred from e"
    o["graph_nodes"] = BASE + PAIRS + edges + " select path, count(*) as deg from (select a as path from e union all select b from e) group by path order by deg desc, path limit 200"
    hue = "212 + (doc_id * 0.6180339887::double % 1) * 94"
    o["community_color"] = f"""select doc_id as community, printf('hsl(%.1f, 66%%, %d%%)', {hue}, case when doc_id % 2 = 0 then 70 else 54 end) as dark,
      printf('hsl(%.1f, 66%%, %d%%)', {hue}, case when doc_id % 2 = 0 then 42 else 30 end) as paper from documents"""
    o["conversation_texts"] = "select conv_id, count(*) as turns, string_agg(coalesce(text, ''), '' order by turn, role, text) as text from conversations group by conv_id"
    o["maintained_index"] = BASE + " select case when mtime % 19 = 1 then concat('moved/', path) else path end as path, stem, n from counts join notes using (path) where mtime % 19 = 1 or (mtime % 17 <> 0 and mtime % 13 <> 5)"
    o["routed_frames"] = """select cast(conv_id as varchar) as connection, cast(10 * turn as bigint) as seq, case when turn % 3 = 0 then 'rpc' else 'chat' end as route
      from conversations where conv_id % 5 <> 0 and turn % 3 < 2 and (conv_id % 3 <> 0 or 10 * turn > 15)"""
    o["chat_turns"] = "select cast(conv_id as varchar) as turn, md5(string_agg(coalesce(text, ''), '' order by turn)) as digest, 'ok' as answer, true as done from conversations group by conv_id"
    o["debounce_events"] = """with g as (select *, case when ts < lag(ts) over w + interval 10 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
      s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as b from g)
      select user_id, min(ts) as start, count(*) as n, arg_max(event_id, ts) as last_event from s group by user_id, b"""
    return o
