"""Run-time settings. Every operator takes them as keyword arguments; these are the defaults."""

# The batch cut, the frame limit, the bucket defaults and the bucket's ceiling.
BATCH_MAX_EVENTS = 64
BATCH_MAX_BYTES = 56 * 1024
FRAME_MAX_PAYLOAD = 64 * 1024
RATE_PER_SECOND = 10_000
BURST = 50_000
BURST_CEILING = 4_194_303
LOG_DIR = "/var/log/pods"

# Frame kinds on the wire.
FRAME_REGISTER = 1
FRAME_BATCH = 2

# Order values per chunk of a stream that carries its own sequence number (see operators.chunks).
CHUNK_SPAN = 1 << 20
# A stream of up to this many rows is not cut into chunks at all.
CHUNK_ROWS = 1 << 17
# Chunks of one stream whose tables pass one task; neighbours are joined in a stream that has more.
MOST_CHUNKS = 1 << 8
# A lookup table up to this many bytes (as JSON) is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
