from tidemark.engine.api import Engine
from tidemark.engine.catalog import Catalog
from tidemark.engine.session import session, ship

__all__ = ["Catalog", "Engine", "session", "ship"]
