"""noteflow.operators"""
