from . import meta, pytext, text, vectors

__all__ = ["meta", "pytext", "text", "vectors"]
