"""Query operators: each takes DataFrames and returns a lazy DataFrame."""

from trendlens.operators.adhoc import BoundedResult, DeadlineExceeded, TooLarge, bounded_frame, bounded_select
from trendlens.operators.bitmaps import counts_from_bitmaps, day_bitmaps, numbered, video_numbers
from trendlens.operators.counts import country_counts, country_counts_totals
from trendlens.operators.edits import affected, delete_rows, insert_rows, inserted_rows, rows_affected, update_rows
from trendlens.operators.fallback import counts_or_raw, flows_or_raw
from trendlens.operators.flows import country_flows, country_flows_raw, flow_totals, flows_of_video
from trendlens.operators.maps import country_names, map_counts
from trendlens.operators.meta import channel_countries, date_range, trending_dates
from trendlens.operators.ranking import best_row_per, top_channels, top_videos, top_videos_on, videos_by_flow
from trendlens.operators.tags import changed_tags, explode_tags, tag_changes, top_tags
from trendlens.operators.timeline import views_timeline

__all__ = [
    "BoundedResult", "DeadlineExceeded", "TooLarge", "affected", "best_row_per", "bounded_frame", "bounded_select",
    "changed_tags", "channel_countries", "counts_from_bitmaps", "counts_or_raw", "country_counts",
    "country_counts_totals", "country_flows", "country_flows_raw", "country_names", "date_range", "day_bitmaps",
    "delete_rows", "explode_tags", "flow_totals", "flows_of_video", "flows_or_raw", "insert_rows", "inserted_rows",
    "map_counts", "numbered", "rows_affected", "tag_changes", "top_channels", "top_tags", "top_videos", "top_videos_on",
    "trending_dates", "update_rows", "video_numbers", "videos_by_flow", "views_timeline",
]
