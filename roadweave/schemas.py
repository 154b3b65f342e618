"""Schemas of messages, payloads and tables."""

from __future__ import annotations

READING = """
    request_time string, requested_lat double, requested_lon double, location_name string, frc string,
    current_speed double, free_flow_speed double, current_travel_time int, free_flow_travel_time int,
    confidence double, road_closure boolean, weather_temp double, weather_humid int,
    weather_wind double, weather_rain double, weather_main string
"""

FLOW_PAYLOAD = """
    flowSegmentData struct<frc: string, currentSpeed: double, freeFlowSpeed: double,
        currentTravelTime: int, freeFlowTravelTime: int, confidence: double, roadClosure: boolean>
"""

WEATHER_PAYLOAD = """
    main struct<temp: double, feels_like: double, humidity: int>,
    weather array<struct<main: string, description: string>>,
    wind struct<speed: double>, rain struct<`1h`: double>
"""

# coordinates stay text: a point is one pair, a line is a list of pairs
INCIDENT_PAYLOAD = """
    incidents array<struct<
        geometry: struct<type: string, coordinates: string>,
        properties: struct<id: string, iconCategory: int, magnitudeOfDelay: int,
            events: array<struct<description: string, code: int>>, startTime: string, endTime: string,
            `from`: string, `to`: string, length: double, delay: double, roadNumbers: array<string>>>>
"""

LOCATION_STATS = """
    level string, key string, avg_speed double, avg_free_flow_speed double, avg_congestion_ratio double,
    avg_delay_seconds double, sample_count bigint, district string, lat double, lon double, frc string
"""

# table -> time column its date partition is taken from
TABLE_TIME = {
    "raw_events": "request_time",
    "weather_events": "recorded_at",
    "traffic_aggregates": "window_start",
    "anomalies": "detected_at",
    "predictions": "predicted_at",
    "alerts": "triggered_at",
    "traffic_incidents": "fetched_at",
    "forecasts": "forecast_made_at",
    "ai_summaries": "generated_at",
    "data_quality_events": "checked_at",
    "fact_traffic": "event_time",
    "raised_alerts": "triggered_at",
    "late_readings": "request_time",
    "road_lags": "event_time",
}
