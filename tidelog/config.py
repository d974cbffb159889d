"""Thresholds and word tables; every operator takes them as parameters with these defaults."""

from __future__ import annotations

# Limits and weights that results depend on.
COMMON_SHARE, RARE_SHARE = 0.25, 0.05  # document shares: dropped above, rare up to
SENTENCE_TERMS = 4  # from so many terms on a query is a sentence
KEEP = 24  # records a query keeps
RUN_GAP_S, SPAN_CAP_S, GLANCE_S = 900, 300, 60
CHUNK_CHARS, CHUNK_STRIDE, CHUNK_MOST, CHUNK_LEAST = 220, 180, 10, 8
LINK_COSINE, SEARCH_COSINE, CLUSTER_COSINE = 0.70, 0.50, 0.62
RRF_LEXICAL, RRF_VECTOR = 20, 60
FIELD_WEIGHTS = {"title": 3.0, "meta": 1.2, "text": 1.0}
MENU_RUN, MENU_LINES, LINE_REPEAT, LINE_DOCS, LINE_MOST = 5, 20, 4, 3, 90
KEPT_SHARE = 0.35
ENTITY_DOCS = (2, 30)
SHARED_MOST = 60  # larger same-page groups say nothing

STOP_WORDS = (
    "a an and are as at be been but by did do does for from had has have how i in is it its me my of on or our "
    "so that the their them then there these they this to was we were what when where which who why will with you your"
).split()
SITES = {
    "github.com": "GitHub", "gitlab.com": "GitLab", "stackoverflow.com": "Stack Overflow", "wikipedia.org": "Wikipedia",
    "youtube.com": "YouTube", "reddit.com": "Reddit", "medium.com": "Medium", "nytimes.com": "New York Times",
    "bbc.co.uk": "BBC", "mail.google.com": "Gmail", "docs.google.com": "Google Docs",
}
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
BROWSERS = r"(?i)chrome|chromium|safari|firefox|edge|opera|brave|vivaldi"
# Parameters that only track, what hangs off a post, and the paths of posts by site.
TRACKING = (
    r"^(utm_\w+|fbclid|gclid|igshid|spm|spm_id_from|vd_source|from_source|from_spmid|share_source|share_medium|share_plat|share_tag|share_session_id|"
    r"unique_k|s|t|ref|ref_src|ref_url|refer|refer_flag|xhsshare|appuid|apptime|si|feature|pp)$"
)
POST_VIEW = r"/(analytics|photo/\d+|video/\d+|retweets|likes|quotes|history|hidden|comment)/?$"
POST_PATHS = {
    r"(^|\.)(x|twitter)\.com$": r"/status/\d+",
    r"(^|\.)reddit\.com$": r"(?i)/comments/[a-z0-9]+",
    r"(^|\.)xiaohongshu\.com$": r"(?i)/(explore|discovery/item)/[a-z0-9]+",
    r"(^|\.)zhihu\.com$": r"/(question/\d+/answer/\d+|answer/\d+|p/\d+|pin/\d+)",
    r"(^|\.)bilibili\.com$": r"/(video/[A-Za-z0-9]+|read/cv\d+|opus/\d+)",
}
PAGE_KEY_CHARS = 4
# Names of programs and of their shells, which are no pages.
SHELLS = (
    "google chrome", "chrome", "safari", "firefox", "arc", "microsoft edge", "claude", "chatgpt", "wechat", "微信", "terminal", "iterm2", "finder", "new tab",
    "新标签页", "untitled", "无标题", "google maps", "谷歌地图", "google translate", "gmail", "notion", "youtube", "x", "facebook",
)
