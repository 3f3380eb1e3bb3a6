"""Searches and pages through stored indexes: the rows of the plain forms, from fewer bytes."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, feedback
from bindings.registry import query
from bindings.reports import ORDER_PRIORITY_SQL, _orders
from vocspark.operators import paged_table, search_index
from vocspark.session import scratch_path

WANTED = "Thort"


@query("search_indexed", f"""WITH {FEEDBACK_SQL} SELECT doc_id, feedback_id, created FROM fb
 WHERE contains(lower(feedback), '{WANTED.lower()}') OR contains(lower(title), '{WANTED.lower()}')""")
def search_indexed(spark, folder):
    """All hits of a search over title and whole text, through trigram postings of all documents."""
    index = search_index.build_search_index(feedback(spark, folder), scratch_path(spark, "search-index"))
    return index.search(WANTED).select("doc_id", "feedback_id", "created")


@query("deep_page", f"""WITH {ORDER_PRIORITY_SQL} SELECT o_orderkey AS feedback_id, priority FROM o
 ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, o_orderkey LIMIT 50 OFFSET 9950""")
def deep_page(spark, folder):
    """Page 200 by priority, from a view of all orders stored in that order."""
    pages = paged_table.write_pages(_orders(spark, folder), scratch_path(spark, "pages"), "priority", range_rows=4096)
    return pages.page(200).select("feedback_id", "priority")


@query("deep_page_newest", f"""WITH {FEEDBACK_SQL} SELECT doc_id, created FROM fb ORDER BY created DESC, feedback_id LIMIT 20 OFFSET 600""")
def deep_page_newest(spark, folder):
    """Page 31 of all documents, newest first."""
    pages = paged_table.write_pages(feedback(spark, folder).select("doc_id", "feedback_id", "created"), scratch_path(spark, "pages"), range_rows=4096)
    return pages.page(31, 20).select("doc_id", "created")
