"""noteflow.streaming"""
