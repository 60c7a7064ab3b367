from rollcall.sources.fleet_log import heartbeats, losses, message_log, registrations
from rollcall.sources.tables import table, table_stream
from rollcall.sources.workspace import new_folder

__all__ = [
    "heartbeats",
    "losses",
    "message_log",
    "new_folder",
    "registrations",
    "table",
    "table_stream",
]
