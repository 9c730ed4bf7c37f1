"""patientflow: a PySpark-native engine for longitudinal patient-event data."""
