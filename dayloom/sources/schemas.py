"""The declared schemas of JSON sources."""

from __future__ import annotations

#: A page of bookmarks with its side-loaded authors and media.
BOOKMARK_PAGE = """
data array<struct<id: string, text: string, created_at: string, author_id: string, attachments: struct<media_keys: array<string>>,
  entities: struct<urls: array<struct<url: string, expanded_url: string, display_url: string>>, hashtags: array<struct<text: string>>,
                   annotations: array<struct<normalized_text: string>>>,
  context_annotations: array<struct<domain: struct<name: string>, entity: struct<name: string>>>>>,
includes struct<users: array<struct<id: string, username: string, name: string>>,
                media: array<struct<media_key: string, type: string, url: string, preview_image_url: string>>>
"""

#: The same page as it was answered: the token it was asked with, the next page's, and an error's status and text in place of data.
ANSWERED_PAGE = f"token string, status int, detail string, meta struct<result_count: int, next_token: string>, {BOOKMARK_PAGE.strip()}"
