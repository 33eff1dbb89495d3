"""noteflow.sources"""
