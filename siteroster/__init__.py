"""Tables of fetched web pages in, one clean contact row per company out."""

from siteroster.config import DirectoryConfig

__all__ = ["DirectoryConfig"]
