"""The ride-count operator over a stream of ticket files."""

from ridecast.streaming.rides import ride_counts_stream, start_ride_counts  # noqa: F401
